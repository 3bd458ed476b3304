"""Plans of quillspark."""
