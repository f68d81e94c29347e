"""Query plans: the SQL gate, guarded execution, and the question-answering engine."""
