"""No streaming operator is in scope: every mart and series here is a batch DataFrame."""
