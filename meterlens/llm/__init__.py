"""Operators of a training-data pipeline over tables of whole texts. Nothing else in the
library imports this folder."""
