"""Train, measure, store and accept or roll back a model.

python -m payguard.jobs.train TRANSACTIONS MODEL_STORE
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from payguard.ml.train import run_training
from payguard.sources.tables import read_table

if __name__ == "__main__":
    session = SparkSession.builder.appName("train").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(run_training(session, read_table(session, "transactions", sys.argv[1]), sys.argv[2])))
