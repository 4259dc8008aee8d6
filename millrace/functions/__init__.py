"""Part of millrace; see README.md."""
