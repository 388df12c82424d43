"""quarry: data operators for corpora, model outputs, spectra and vectors, as Spark DataFrame functions."""
