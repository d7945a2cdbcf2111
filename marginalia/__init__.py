"""marginalia: transcription-quality analytics as Spark DataFrame plans."""
