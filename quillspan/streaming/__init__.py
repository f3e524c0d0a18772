"""quillspan streaming."""
