"""What the near-duplicate operator keeps on disk while it runs."""

from kinweave.llm import near_dup


def test_wide_tables_go_after_their_last_reader(spark, monkeypatch):
    """When the full sets are read, the sketches with registers and keys are gone, and so are the bands."""
    left, kept = [], {}

    def stored(df, keep=False, _f=near_dup.stored):
        out = _f(df, keep)
        kept[out._kinweave_path] = set(df.columns)
        return out

    def full_sets(*args, _f=near_dup._full_sets):
        from kinweave.llm import shared

        there = {p for paths in (shared._paths, *shared._open) for p in paths}
        left.append([kept[p] for p in there if p in kept])
        return _f(*args)

    monkeypatch.setattr(near_dup, "stored", stored)
    monkeypatch.setattr(near_dup, "_full_sets", full_sets)
    texts = [f"word{i} " * 3 + " ".join(f"w{j}" for j in range(60)) for i in range(12)]
    rows = near_dup.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == 12 and {r["component_id"] for r in rows} == {0}
    assert left and not any({"regs", "keys"} & columns or columns == {"sig", "key"} for columns in left[0])
