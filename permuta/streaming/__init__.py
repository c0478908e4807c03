"""Extensions for streams of series values."""
