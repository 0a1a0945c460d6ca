from tessera.llm import linededup
from tests.llm.tools import ODD, docs, rows


def brute(given, sites):
    normal = lambda x: x.strip(" \t\r").lower()
    where = {}
    for i, t, s in given:
        for line in (t or "").split("\n"):
            if normal(line) and s is not None:
                where.setdefault(normal(line), set()).add(s)
    bad = {k for k, v in where.items() if len(v) >= sites}
    out = []
    for i, t, s in given:
        if t is None:
            out.append((i, 0, None))
            continue
        kept = [x for x in t.split("\n") if normal(x) not in bad]
        whole = not any(normal(x) for x in kept)
        out.append((i, 0 if whole else t.count("\n") + 1 - len(kept), t if whole else "\n".join(kept)))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def test_against_brute_force(spark):
    given = [(k, f"own line {k}\n Shared LINE \nalmost {k % 9}\n{'long ' * 50}", f"site{k % 12}") for k in range(40)]
    given += [(50, "shared line", "x"), (51, "shared line\n\n  ", "y"), (52, "shared line\t\r\nmine", None)] + [(*r, "s") for r in ODD]
    done = linededup.line_dedup(docs(spark, given))
    assert rows(done.select("row.doc_id", "removed", "kept")) == brute(given, linededup.MIN_SITES)
    assert done.selectExpr("row.*").columns == docs(spark, []).columns


def test_threshold_is_exact(spark):
    given = [(k * 100 + j, f"line {k}\nmine {k} {j}", f"site{j}") for k in range(6, 14) for j in range(k)]
    removed = {r[0] // 100 for r in linededup.line_dedup(docs(spark, given), lg_k=4).where("removed > 0").select("row.doc_id").collect()}
    assert removed == {10, 11, 12, 13}  # with a coarse sketch too


def test_stage_and_nothing(spark):
    given = [(k, f"shared line\nown {k}", f"site{k}") for k in range(10)]
    out = linededup.without_boilerplate(docs(spark, given))
    assert out.columns == docs(spark, []).columns and {(r["text"], r["n_chars"]) for r in out.collect()} == {(f"own {k}", 5) for k in range(10)}
    assert rows(linededup.without_boilerplate(docs(spark, []))) == []


def test_stage_takes_long_lines_too(spark):
    long = "a long line of the footer " * 60
    given = [(k, f"{long}\nown {k}\n{'rare ' * 50}{k % 9}", f"site{k}") for k in range(10)]
    out = {r["doc_id"]: r["text"] for r in linededup.without_boilerplate(docs(spark, given)).collect()}
    assert out == {k: f"own {k}\n{'rare ' * 50}{k % 9}" for k in range(10)}


def test_copied_texts_stay_whole(spark):
    """A text of boilerplate alone keeps all its lines, long and short."""
    body = "a body that ten sites copied " * 20
    given = [(k, f"{body}\nsecond part\nfooter", f"site{k}") for k in range(10)] + [(20, "footer", "x"), (21, "footer\nown", "x")]
    out = {r["doc_id"]: r["text"] for r in linededup.without_boilerplate(docs(spark, given)).collect()}
    assert out == {k: f"{body}\nsecond part\nfooter" for k in range(10)} | {20: "footer", 21: "own"}


def test_clashing_names(spark):
    given = docs(spark, [(k, f"shared line\nown {k}", f"site{k}") for k in range(10)])
    names = dict(zip(("lang", "key", "content", "score", "a", "b", "start", "line_hash", "count"), ("row", "removed", "kept", "bad", "t1", "t2", "site", "__bad", "lines")))
    out = linededup.without_boilerplate(given.withColumnsRenamed(names))
    assert out.columns == given.withColumnsRenamed(names).columns and {r["text"] for r in out.collect()} == {f"own {k}" for k in range(10)}
    again = linededup.without_boilerplate(out)
    assert again.columns == out.columns and again.count() == 10
