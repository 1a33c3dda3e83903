"""Clip mining and content operations on Spark: operators over DataFrames of many recordings, clips, posts and threads."""
