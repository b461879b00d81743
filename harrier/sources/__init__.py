"""Sources and sinks: file scans, manifests, judgements, runs and tables."""
