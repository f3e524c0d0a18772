"""quillspan functions."""
