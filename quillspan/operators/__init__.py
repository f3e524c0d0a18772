"""quillspan operators."""
