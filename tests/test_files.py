"""Many files with few headers, dictionaries of features, and writers that want the same link."""

import threading

import pytest

from tracelake.operators import custody
from tracelake.sources import files


def test_many_files_are_a_branch_per_header(spark, tmp_path):
    heads = ["x,y", "y,x,Flow Rate", "﻿z"]
    for i in range(300):
        (tmp_path / f"{i % 7}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 7}/{i}.csv").write_text(heads[i % 3] + "\n" + ",".join(f"{c.strip()[-1]}{i}" for c in heads[i % 3].split(",")) + "\n")
    (tmp_path / "0/odd [1]{2}.csv").write_text("z\nw\n")
    (tmp_path / "0/skip.txt").write_text("x,y\n1,2\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many-files", "")
    try:
        found = files.read_many_csv(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # listing 300 files takes a job or two, reading their headers two more; none is for one file
    assert len(tracker.getJobIdsForGroup("many-files")) < 12
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 3
    rows = {r.source_path.rsplit("/", 1)[-1]: r for r in found.collect()}
    assert len(rows) == 301 and found.columns[0] == "seq"
    for i in range(300):
        r = rows[f"{i}.csv"]
        want = {0: (f"x{i}", f"y{i}", None, None), 1: (f"x{i}", f"y{i}", f"e{i}", None), 2: (None, None, None, f"z{i}")}[i % 3]
        assert (r.x, r.y, r.flow_rate, r.z) == want
    with pytest.raises(FileNotFoundError):
        files.read_many_csv(spark, str(tmp_path), "*.tsv")


def test_equal_names_in_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Len,other,len,\n1,2,3,4\n")
    found = files.read_many_csv(spark, str(tmp_path)).drop("seq", "source_path")
    assert found.columns == files.read_flow_csv(spark, str(tmp_path / "a.csv")).columns[1:] and tuple(found.first()) == ("1", "2", "3", "4")


def test_dictionary(spark, tmp_path):
    (tmp_path / "features.csv").write_bytes("No.,Name,Type ,Description\n2,Src Port,integer,tel – é\n1,srcip,nominal,a\n3,dur,Float,b\n".encode("windows-1252"))
    dictionary = files.read_dictionary(spark, str(tmp_path / "features.csv"))
    (tmp_path / "data.csv").write_text("1.1.1.1,80,0.5\n1.1.1.2,0x50,inf\n")
    found = files.bind_dictionary(spark, str(tmp_path / "data.csv"), dictionary)
    assert found.dtypes == [("seq", "bigint"), ("srcip", "string"), ("src_port", "bigint"), ("dur", "double")]
    assert [tuple(r)[1:] for r in found.orderBy("seq").collect()] == [("1.1.1.1", 80, 0.5), ("1.1.1.2", None, float("inf"))]
    (tmp_path / "own.csv").write_text("SrcIP,src port, DUR\n1.1.1.1,80,0.5\n")
    assert files.bind_dictionary(spark, str(tmp_path / "own.csv"), dictionary).count() == 1
    (tmp_path / "wide.csv").write_text("1.1.1.1,80,0.5,extra,more\n")
    with pytest.raises(ValueError, match=r"column 4 \('extra'\), column 5 \('more'\)"):
        files.bind_dictionary(spark, str(tmp_path / "wide.csv"), dictionary)
    (tmp_path / "narrow.csv").write_text("1.1.1.1\n")
    with pytest.raises(ValueError, match="src_port, dur"):
        files.bind_dictionary(spark, str(tmp_path / "narrow.csv"), dictionary)
    with pytest.raises(ValueError, match="unknown types: x \\(odd\\)"):
        files.bind_dictionary(spark, str(tmp_path / "data.csv"), spark.createDataFrame([(1, "x", "odd")], "no int, name string, type string"))
    with pytest.raises(ValueError, match="a twice"):
        files.bind_dictionary(spark, str(tmp_path / "data.csv"), spark.createDataFrame([(1, "A", "float"), (2, "a", "float")], "no int, name string, type string"))


def test_writers_of_one_link(spark, tmp_path):
    """Six writers at a time, each until it has a link of its own: no number twice, no gap."""
    path = str(tmp_path / "chain")
    custody.CustodyChain(spark, path)
    lost, done = [], []

    def write(k):
        chain = custody.CustodyChain(spark, path)
        while True:
            try:
                done.append(chain.append("case", "step", f"writer{k}", None, None).idx)
                return
            except custody.CustodyConflict:
                lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = custody.CustodyChain(spark, path)
    assert sorted(done) == [1, 2, 3, 4, 5, 6] and lost
    assert found.verify("case", expected=6)["valid"]
    assert [r.idx for r in found.chain("case").collect()] == [1, 2, 3, 4, 5, 6]


def test_a_writer_that_died_gives_no_link_away(spark, tmp_path, monkeypatch):
    chain = custody.CustodyChain(spark, str(tmp_path / "chain"))
    monkeypatch.setattr(custody, "PATIENCE", 0.2)
    import hashlib

    folder = tmp_path / "chain/_claims" / f"{hashlib.sha256(b'case').hexdigest()}-1"
    folder.mkdir(parents=True)
    (folder / "dead.mark").write_text("")
    with pytest.raises(custody.CustodyConflict):
        chain.append("case", "step", "x", None, None)
    (folder / "dead.mark").unlink()
    assert chain.append("case", "step", "x", None, None).idx == 1
