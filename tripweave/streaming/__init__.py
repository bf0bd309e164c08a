"""No streaming operators: every input of the analytics is a finished table."""
