"""spanveil: text-privacy analytics on Spark DataFrames.

Documents go in as a DataFrame; detected spans, resolved entities, redacted
text and quality metrics come out as DataFrames.
"""
