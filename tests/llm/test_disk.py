"""op4 gives disk back before its next step needs more."""

from pathlib import Path

from spectraloom.llm import suffixes


def test_tables_and_shuffles_go_before_the_next_step(spark, monkeypatch):
    text = "one passage of well over fifty bytes that two texts of this table have in common "
    docs = spark.createDataFrame([(1, "a " + text + "b"), (2, "c " + text + "d"), (3, None)], "doc_id long, text string")
    names, log, path = {"anchors": "shared", "at": "found", "key": "distinct", "runs": "runs", "cuts": "cuts"}, [], {}
    store, discard, release = suffixes.stored, suffixes.discard, suffixes.release

    def stored(df):
        out = store(df)
        name = next((names[c] for c in reversed(df.columns) if c in names and not (c == "at" and "cuts" in df.columns)), "large")
        path[out._scratch_path] = "found" if "doc_id" in df.columns and "at" in df.columns else name
        log.append(path[out._scratch_path])
        return out

    monkeypatch.setattr(suffixes, "stored", stored)
    monkeypatch.setattr(suffixes, "discard", lambda *t: (log.extend("-" + path[x._scratch_path] for x in t), discard(*t)))
    monkeypatch.setattr(suffixes, "release", lambda s: (log.append("release"), release(s)))
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans]) for r in suffixes.remove(docs).collect()}
    assert got[1][1] == [] and got[3] == (0, []) and got[2][1] == [(1, 2 + len(text))]
    at = log.index
    assert at("-shared") < at("distinct") < at("large") < at("runs") < at("-distinct") < at("cuts")
    assert "release" in log[at("distinct") : at("runs")]


def test_stretches_are_settled_in_parts(spark, monkeypatch):
    """A part's stretches and tables are gone before those of the next are made; the rows are those of one pass."""
    texts = [f"{i} " + "".join(f"passage {j} that some of these texts have in common, of well over fifty bytes; " for j in range(i % 5, i % 5 + 3)) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(str, suffixes.remove(docs).collect()))
    there, store = [], suffixes.stored

    def stored(df):
        out = store(df)
        if df.columns == ["anchor", "bytes", "first", "key"]:
            there.append([*(Path(suffixes.scratch_dir(spark).removeprefix("file://")).glob("*/part=*"))])
        return out

    monkeypatch.setattr(suffixes, "stored", stored)
    got = sorted(map(str, suffixes.remove(docs, suffixes.Settings(pass_stretches=1, passes=3)).collect()))
    assert got == want and any("start" in r for r in got)
    assert [len(x) for x in there] == [3, 2, 1]
