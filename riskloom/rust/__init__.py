"""Rust source text to flat rows of syntax nodes."""
