"""Operators for training-data pipelines: filters, deduplication, masking, scoring and packing.

Every operator takes DataFrames, reads whole texts and covers all rows. Work on
the text of one document runs in Arrow batches inside the scan stage; whatever
crosses documents is a Spark join, aggregate or shuffle. Tables needed more than
once are written below ``spark.checkpoint.dir`` and read again, so a lost
executor costs a task and not the job.
"""
