"""Values are written to vaults alone, and vaults go."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilwork.config import Detect
from veilwork.functions.shared import shared_folder
from veilwork.functions.vault import Vault, vault
from veilwork.operators import masking as M
from veilwork.plans import compliance, detection


def contents(folder):
    """All that files hold, parquet read as rows."""
    out = []
    for base, _, names in os.walk(folder):
        for n in names:
            path = os.path.join(base, n)
            out.append((path, str(pq.read_table(path).to_pylist()) if n.endswith(".parquet") else open(path, "rb").read().decode("latin-1")))
    return out


def test_a_vault_is_gone_after_its_block(spark):
    rows = spark.createDataFrame([(1, 1, "mail a@example.com")], "s long, o long, text string")
    with Vault(spark) as own:
        values = M.met(M.detected(rows, Detect(only=("EMAIL",))), "s", "o")
        assert vault(spark) is own
        tokens = M.session_tokens(values, "s", "o")
        assert M.tokenized(rows, values, tokens, "s").head()["masked"] == "mail [EMAIL_0]"
        assert any("a@example.com" in c for _, c in contents(own.path.removeprefix("file:")))
    assert not os.path.exists(own.path.removeprefix("file:"))
    assert vault(spark) is not own
    with pytest.raises(ZeroDivisionError), Vault(spark) as own:
        own.keep(rows)
        raise ZeroDivisionError
    assert not os.path.exists(own.path.removeprefix("file:"))


@pytest.mark.parametrize("name", ["tokenize_documents", "guard_sanitize", "guard_desanitize", "restore_roundtrip", "present_tokens", "token_summary", "masked_conversations", "stream_restore", "stream_sessions"])
def test_no_value_is_left_in_any_folder(spark, data, name):
    folder = shared_folder(spark).removeprefix("file:")
    before = {p for p, _ in contents(folder)}
    out = (detection.QUERIES | compliance.QUERIES)[name](spark, data)
    out.write.format("noop").mode("overwrite").save()
    mails = {r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select(F.explode(F.regexp_extract_all("text", F.lit(r"[a-z0-9.]+@[a-z0-9.]+"), F.lit(0)))).distinct().collect()}
    assert mails
    for path, held in contents(folder):
        if path not in before:
            assert "/result-" in path or "/streamed-" in path or "/rdd-" in path, path
            assert "@example.com" not in held, path
            assert not any(m in held for m in mails), path
