"""firmscope — company-table analytics on Spark.

Clean dirty firmographic records, impute revenue and headcount with an exact
distributed nearest-neighbour join, build features and industry benchmarks,
segment with k-means, score leads, flag risks (isolation forest grown and
scored on Spark), and answer report queries over the results.
"""

from firmscope.config import DEFAULT, Config

__all__ = ["Config", "DEFAULT"]
