"""Sources and sinks: test tables, message relations, payload ingest, lexicon IO."""
