"""Reading and writing tables, schemas and generated ground truth."""
