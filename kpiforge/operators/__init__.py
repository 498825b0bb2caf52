"""Operators over the ``order_lines`` DataFrame and over text tables."""
