"""Engines that turn files into findings, and the operators that merge them."""
