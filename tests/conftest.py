import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    home = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"{home}/shared")
        .config("spark.sql.warehouse.dir", f"{home}/warehouse").config("spark.local.dir", f"{home}/local")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SCRIPT = """Title: The Long Wait
Author: A. Writer

/* a note
over two lines */
INT. KITCHEN - NIGHT

RAVI (30s, unshaven) stares at the GOLD WATCH.

RAVI
(softly)
I'll tell you tomorrow.

MEERA (O.S.)
You always say that?
No you don't.

CUT TO:

EXT. STREET - DAY

Ravi walks. The GOLD WATCH ticks.

@Old Man
I am so tired.

TWO DAYS LATER

.THE ROOF

ANGLE ON the sky.

RAVI
~la la
Done.

> FADE OUT.
THE END
"""


@pytest.fixture(scope="session")
def parsed(spark):
    from reelframe.sources.screenplay import parse

    texts = spark.createDataFrame([("s1", "fountain", "a.fountain", SCRIPT)], "script_id string, source_format string, source_filename string, text string")
    return {k: v.cache() for k, v in parse(texts).items()}
