"""No streaming operators: every input of this engine is a snapshot table."""
