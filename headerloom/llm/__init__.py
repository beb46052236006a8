"""Training-data operators over document tables.

Nothing outside this subpackage (and corpus_pipeline.py) imports it, so it can
be removed without touching the header-forensics engine.
"""
