"""Streaming ingestion: new, changed, replayed and torn batches."""

import os
import shutil
import time

import pytest

from tessera.plans.config import ChunkConfig
from tessera.streaming.ingestion import CHUNKS, SOURCE, Ingestion

BODY = "Plain words about control systems make a sentence of some length. Others follow it, with more data and figures. "


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a.txt", "b.md", "deep/c.TXT"):
        (tmp_path / "in" / name).write_text(f"{name} {BODY}" * 8)
    (tmp_path / "in" / "tiny.txt").write_text("tiny")
    (tmp_path / "in" / "bad.pdf").write_bytes(b"%PDF-1.4 cut")
    (tmp_path / "in" / "skip.bin").write_text(BODY)
    return tmp_path


def _made(spark, folder, **more):
    return Ingestion(spark, str(folder / "in"), str(folder / "out"), str(folder / "cp"), cfg=ChunkConfig(least_score=0.0), **more)


def _states(job):
    return {os.path.basename(r["path"]): r["state"] for r in job.manifest().collect()}


def _chunks(job):
    return sorted((os.path.basename(r["path"]), r["chunk_no"], r["page_content"]) for r in job.chunks().collect())


def test_new_files(spark, folder):
    job = _made(spark, folder, per_batch=2)
    assert job.chunks().count() == 0 and job.manifest().count() == 0
    job.run()
    assert _states(job) == {"a.txt": "stored", "b.md": "stored", "c.TXT": "stored", "tiny.txt": "rejected", "bad.pdf": "failed"}
    first = _chunks(job)
    assert {n for n, _, _ in first} == {"a.txt", "b.md", "c.TXT"} and len(first) == len(set(first))
    assert len(job._batches("manifest")) >= 3  # two files a batch
    (folder / "in" / "d.txt").write_text(f"d {BODY}" * 8)
    job.run()
    assert [c for c in _chunks(job) if c[0] != "d.txt"] == first and any(c[0] == "d.txt" for c in _chunks(job))
    assert len(_chunks(job)) == len(set(_chunks(job)))


def test_changed_files_leave_no_stale_chunk(spark, folder):
    job = _made(spark, folder)
    job.run()
    time.sleep(1.1)
    (folder / "in" / "a.txt").write_text(f"changed {BODY}" * 3)
    job.run()
    got = [c for c in _chunks(job) if c[0] == "a.txt"]
    assert got and all("a.txt" not in text for _, _, text in got) and "changed" in got[0][2]
    assert job.sweep() == 0
    # touched, but not changed: nothing is added
    before = _chunks(job)
    os.utime(folder / "in" / "b.md", (time.time() + 5, time.time() + 5))
    assert job.sweep() == 1
    assert _chunks(job) == before


def _arrived(spark, folder):
    return spark.read.format("binaryFile").schema(SOURCE).option("recursiveFileLookup", "true").load(str(folder / "in"))


def test_a_replayed_batch_adds_nothing(spark, folder):
    job = _made(spark, folder)
    rows = _arrived(spark, folder)
    job.take(rows, "s1")
    once, states = _chunks(job), _states(job)
    job.take(rows, "s1")
    assert _chunks(job) == once and _states(job) == states
    job.take(rows, "s2")  # the same files in another batch
    assert _chunks(job) == once and _states(job) == states


def test_a_batch_cut_off_before_its_manifest_does_not_count(spark, folder):
    job = _made(spark, folder)
    job.take(_arrived(spark, folder), "s1")
    whole = _chunks(job)
    shutil.rmtree(folder / "out" / "manifest")
    assert _chunks(job) == [] and spark.read.schema(CHUNKS).parquet(str(folder / "out" / "chunks")).count() > 0
    job.take(_arrived(spark, folder), "s1")
    assert _chunks(job) == whole


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    job = _made(spark, tmp_path)
    job.run()
    assert job.chunks().count() == 0 and job.manifest().count() == 0
