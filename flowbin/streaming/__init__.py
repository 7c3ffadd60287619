"""Applying fitted models to a streaming DataFrame.

The reference is batch only; nothing here adds streaming semantics of its
own.  A fitted :class:`~flowbin.operators.binning.BinningModel` is a row-wise
projection (plus stream-static lookup joins for very wide columns), so the
same transform - and a fitted MLlib classifier after it - runs unchanged on a
``readStream`` source.
"""

from flowbin.streaming.scoring import bin_stream, score_stream  # noqa: F401
