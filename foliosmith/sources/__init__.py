"""Sources and sinks: input files, page bundles, document outputs, the memo table."""
