"""Tables, marts and analyses composed from the operators."""
