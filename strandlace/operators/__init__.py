"""Plots, periodograms, spectra, peaks, ridges and the statistics behind them."""
