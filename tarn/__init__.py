"""Tarn: keyed collections, property graphs and vectors as set-at-a-time Spark plans."""
