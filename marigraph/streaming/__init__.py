"""Extensions for streams, which the operators' model has no counterpart for."""
