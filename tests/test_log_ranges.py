"""Logs read by byte ranges, and chains verified by them, against loops over whole files."""

import json
import random

import pytest

from veilwork.functions.canonical import GENESIS, entry_hash
from veilwork.operators import audit
from veilwork.sources.audit_log import BLANK, read_lines


@pytest.fixture
def ranges(spark):
    """Splits of about 500 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def by_loop(folder):
    out = []
    for path in sorted(folder.glob("audit_*.jsonl")):
        parts = path.read_bytes().decode().split("\n")
        out += [(path.name, i, line) for i, p in enumerate(parts, 1) if (line := p.strip(BLANK))]
    return out


def write(folder, seed, files=3, most=120):
    rng = random.Random(seed)
    for k in range(files):
        lines = [rng.choice(["", " ", "\t\r", "x" * rng.randint(1, 900), "é\u2028ü" * rng.randint(1, 30), '{"seq": %d}' % i, "a\rb"]) + rng.choice(["", "\r"]) for i in range(rng.randint(0, most))]
        tail = rng.choice(["", "\n", '{"cut', "\n\n"])
        (folder / f"audit_2025-01-0{k + 1}.jsonl").write_bytes(("\n".join(lines) + tail).encode())


@pytest.mark.parametrize("seed", range(4))
def test_numbers_of_lines_equal_a_loop(spark, tmp_path, ranges, seed):
    write(tmp_path, seed)
    lines = read_lines(spark, str(tmp_path))
    got = sorted((r["file"], r["line_no"], r["line"]) for r in lines.collect())
    assert got == by_loop(tmp_path)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    (tmp_path / "audit_2025-01-01.jsonl").write_text("".join(f"{i} {'y' * 50}\n" for i in range(400)))
    lines = read_lines(spark, str(tmp_path))
    assert lines.select("part").distinct().count() > 20
    assert [(r["line_no"], r["line"].split()[0]) for r in lines.orderBy("line_no").collect()] == [(i + 1, str(i)) for i in range(400)]


def test_empty_files_and_none(spark, tmp_path, ranges):
    assert read_lines(spark, str(tmp_path)).count() == 0
    (tmp_path / "audit_2025-01-01.jsonl").write_text("")
    assert read_lines(spark, str(tmp_path)).count() == 0


def faults_by_loop(folder):
    out, last = [], GENESIS
    for file, no, line in by_loop(folder):
        try:
            entry = json.loads(line)
        except ValueError:
            out.append((file, no, "invalid JSON"))
            continue
        if entry.get("prev_hash") != last:
            out.append((file, no, "chain broken"))
        if entry.get("entry_hash", "") != entry_hash(entry):
            out.append((file, no, "entry tampered"))
        last = entry.get("entry_hash", "")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_faults_in_parts_of_files_equal_a_loop(spark, tmp_path, ranges, seed):
    rng, last, seq = random.Random(seed), GENESIS, 0
    for k in range(2):
        text = ""
        for _ in range(60):
            entry = {"seq": seq, "event_type": "sanitize", "metadata": {"x": "z" * rng.randint(0, 250)}, "prev_hash": last}
            entry["entry_hash"] = last = entry_hash(entry)
            seq += 1
            line = json.dumps(entry)
            match rng.randint(0, 19):
                case 0:
                    line = line[:-9]
                case 1:
                    line = line.replace('"seq": ', '"seq": 1')
                case 2:
                    line = ""
            text += line + rng.choice(["\n", "\r\n", "\n\n"])
        (tmp_path / f"audit_2025-02-0{k + 1}.jsonl").write_bytes(text.encode())
    lines = read_lines(spark, str(tmp_path))
    expected = faults_by_loop(tmp_path)
    assert expected
    assert sorted((r["file"], r["line_no"], r["fault"]) for r in audit.faults(lines).collect()) == sorted(expected)
    got = audit.verify(lines, most=3)
    assert [e.split(" seq")[0] for e in got["errors"]] == [f"{f}:{n}" for f, n, _ in sorted(expected)[:3]]
    assert got["error_count"] == len(expected) and got["final_seq"] >= 100
