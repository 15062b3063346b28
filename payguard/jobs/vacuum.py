"""Remove replaced versions and unnamed folders of a versioned root.

python -m payguard.jobs.vacuum ROOT [SECONDS]; SECONDS is how long they are kept, a day by default.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from payguard.sources.snapshots import GRACE, Snapshots

if __name__ == "__main__":
    session = SparkSession.builder.appName("vacuum").getOrCreate()
    print(Snapshots(session, sys.argv[1]).vacuum(float(sys.argv[2]) if len(sys.argv) > 2 else GRACE))
