"""Training-data operators: thirteen corpus operators and the pipeline that chains five of them.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
