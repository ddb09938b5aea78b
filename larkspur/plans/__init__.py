"""The search language: text, syntax tree, Column."""
