"""The queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op1_decontaminate
from .licenses import op6_licenses
from .media import op9_media
from .mixing import OP3_SQL, op3_mixing
from .pii import op10_pii
from .quality import op4_quality
from .repeats import op8_repeats
from .secrets import op7_secrets
from .simhash import op2_simhash
from .warc import OP5_SQL, op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_decontaminate, op2_simhash, op3_mixing, op4_quality, op5_warc, op6_licenses, op7_secrets, op8_repeats, op9_media, op10_pii)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op5_warc": OP5_SQL}
