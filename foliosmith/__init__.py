"""A PySpark-native document-transcription engine."""
