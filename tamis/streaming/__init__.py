"""Streaming forms: fitted row-wise pipelines on ``readStream``; windowed resampling and
de-duplication with watermarks (the reference itself has no streaming)."""
