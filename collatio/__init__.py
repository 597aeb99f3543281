"""Transcription analytics engine on Spark DataFrames."""
