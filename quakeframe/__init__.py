"""Labelled seismic waveform corpora as Spark DataFrames: build, check, annotate, pick, match, score, measure."""
