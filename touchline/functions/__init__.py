"""Column expressions used inside the jobs; each one stays in whole-stage codegen."""
