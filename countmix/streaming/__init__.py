"""Streaming.

The modelled system has no streams, watermarks or state.  The one piece that
applies unchanged to a stream is the text-to-triplets step: see
:func:`countmix.streaming.counts.stream_term_counts`, which runs the same
operators on a ``readStream`` source and appends triplets per micro-batch.
"""
