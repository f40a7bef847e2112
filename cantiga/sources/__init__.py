"""Tables: where they come from, what is looked up on them, where they go."""
