"""pluvio: hydro-meteorological observations on Spark."""
