"""Part of quillrank."""
