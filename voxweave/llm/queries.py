"""The queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxweave.llm import decontaminate, licenses, minhash
from voxweave.llm.fingerprints import op1_fingerprints
from voxweave.llm.language import op10_language
from voxweave.llm.near import op2_ngram_join
from voxweave.llm.packing import op3_packing
from voxweave.llm.quality import op7_quality
from voxweave.llm.secret_scan import op5_secrets
from voxweave.llm.tables import table
from voxweave.llm.time_layout import op11_time_partitions
from voxweave.llm.toxicity import op4_toxicity
from voxweave.llm.vector_codes import SQL as VECTOR_CODES_SQL
from voxweave.llm.vector_codes import op13_vector_codes
from voxweave.llm.wavelet import op6_wavelet


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": lambda spark, d: op1_fingerprints(table(spark, d, "documents")),
        "op2_ngram_join": lambda spark, d: op2_ngram_join(table(spark, d, "documents")),
        "op3_packing": lambda spark, d: op3_packing(table(spark, d, "documents")),
        "op4_toxicity": lambda spark, d: op4_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
        "op5_secrets": lambda spark, d: op5_secrets(table(spark, d, "documents")),
        "op6_wavelet": lambda spark, d: op6_wavelet(table(spark, d, "documents")),
        "op7_quality": lambda spark, d: op7_quality(table(spark, d, "documents"), table(spark, d, "labels")),
        "op8_decontaminate": lambda spark, d: decontaminate.op8_decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op9_licenses": lambda spark, d: licenses.op9_licenses(table(spark, d, "documents")),
        "op10_language": lambda spark, d: op10_language(table(spark, d, "documents")),
        "op11_time_partitions": lambda spark, d: op11_time_partitions(table(spark, d, "clicks")),
        "op12_minhash_dedup": lambda spark, d: minhash.op12_minhash_dedup(table(spark, d, "documents")),
        "op13_vector_codes": lambda spark, d: op13_vector_codes(table(spark, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": minhash.join_sql(75), "op8_decontaminate": decontaminate.SQL, "op9_licenses": licenses.SQL, "op12_minhash_dedup": minhash.SQL, "op13_vector_codes": VECTOR_CODES_SQL}
