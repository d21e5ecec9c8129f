"""Page references and readers against plain versions and small files."""

import json
import random
import re


def plain_spans(ref, starts, ends):
    ranges = [(int(a), int(b)) for a, b in re.findall(r"(\d{1,4})\s*[-–]\s*(\d{1,4})", ref)] or [(int(n),) * 2 for n in re.findall(r"\d{1,4}", ref)]
    low, high = min(starts), max(starts)
    out = []
    for a, b in ranges:
        b = min(b, high)
        if high - low < 5 or not low <= a <= high:
            continue
        start = ends.get(a - 1, starts.get(a))
        end = starts.get(b, ends.get(b))
        if start is not None and end is not None and end > start:
            out.append((a, -b, b, start, end))
    return sorted(out)


def test_page_references(spark):
    from spanforge.operators.references import resolve_all_ranges, resolve_first_free

    rng, rows = random.Random(7), []
    for doc in range(60):
        pages = sorted(rng.sample(range(1, 40), rng.randint(1, 25)))
        starts = {p: 100 * k + 50 for k, p in enumerate(pages)}
        ends = {p: s + 5 for p, s in starts.items()}
        for k in range(rng.randint(1, 5)):
            piece = lambda: rng.choice([f"{rng.randint(1, 40)}-{rng.randint(1, 60)}", f"{rng.randint(1, 40)} – {rng.randint(1, 60)}", str(rng.randint(1, 40)), "Page", "2-9"])
            rows.append((doc, k, f"c{k}", ", ".join(piece() for _ in range(rng.randint(0, 4))), starts, ends))
    df = spark.createDataFrame(rows, "doc_id long, ord int, code string, page_ref string, starts map<int,long>, ends map<int,long>")
    every = {(r.doc_id, r.code): ([tuple(s) for s in r.spans], r.pages) for r in resolve_all_ranges(df).collect()}
    first = {(r.doc_id, r.code): (r.start, r.end) for r in resolve_first_free(df).collect()}
    taken, want = {}, {}
    for doc, _, code, ref, starts, ends in rows:
        placed = plain_spans(ref, starts, ends)
        spans, pages = [], set()
        for _, _, _, s, e in sorted(placed, key=lambda p: p[3:]):
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
            else:
                spans.append((s, e))
        for a, _, b, _, _ in placed:
            pages.update(range(a, max(a, b) + 1))
        assert every[doc, code] == (spans, len(pages))
        mine = taken.setdefault(doc, set())
        free = next(((s, e) for _, _, _, s, e in placed if (s, e) not in mine), (None, None))
        mine.add(free)
        want[doc, code] = free
    assert first == want and any(s != (None, None) for s in want.values())


def test_readers(spark, tmp_path):
    from spanforge.sources import tables as S

    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        return str(path)

    path = put("list.csv", '﻿fold,uid,cik,company name,date_filed,Link to edgar,SIC\n1, u1 ,7," A, Inc ",2020,http://x,99\n')
    assert [r.asDict() for r in S.report_list(spark, path).collect()] == [{"fold": "1", "uid": "u1", "cik": "7", "company": "A, Inc", "date_filed": "2020", "link": "http://x", "sic": "99"}]
    big = put("big.csv", "id,v\n1,a\n2,b\n3,c\n")
    assert sorted(r.v for r in S.csv_rows_of(spark, big, spark.createDataFrame([("1",), ("3",), ("3",)], "id string"), "id").collect()) == ["a", "c"]
    put("j/a.jsonl", "\n".join(json.dumps({"n": n}) for n in range(5)) + "\n\n")
    put("j/b.jsonl", json.dumps({"n": 9}))
    assert sorted((r.file, r.rank, r.n) for r in S.first_records(spark, str(tmp_path / "j"), "n int", 2).collect()) == [("a.jsonl", 1, 0), ("a.jsonl", 2, 1), ("b.jsonl", 1, 9)]
    index = spark.createDataFrame([("AAPL", 1), ("jpm ", 2)], "ticker string, cik long")
    got = S.ids_by_ticker(spark.createDataFrame([(" aapl",), ("JPM",), ("X",)], "ticker string"), index).collect()
    assert {r.ticker.strip().upper(): r.cik for r in got} == {"AAPL": 1, "JPM": 2, "X": None}
    for name in ("agent-10.png", "agent-2.png", "agent-x.png"):
        put(f"shots/{name}", name)
    assert [r.number for r in S.numbered_files(spark, str(tmp_path / "shots")).collect()] == [2, 10, None]
    log = put("log/run.jsonl", '{"run_id": "a", "x": 1}\n\n{"run_id": "a", "x": 2}\n')
    assert S.evidence_log(spark, log, "run_id string, x int").count() == 2
    broken = put("log2/run.jsonl", '{"run_id": "a", "x": 1}\n{"run_id": \n')
    assert S.evidence_log(spark, broken, "run_id string, x int", skip_corrupt=True).count() == 1
    try:
        S.evidence_log(spark, broken, "run_id string, x int").collect()
        raise AssertionError("a corrupt line was read")
    except Exception as error:
        assert "MALFORMED" in str(error).upper() or "FAILED_READ" in str(error).upper()
    put("rec/a.json", '{\n"k": 1}')
    assert [(r.k, r.file) for r in S.record_files(spark, str(tmp_path / "rec"), "k int").collect()] == [(1, "a.json")]
    fixed = put("form.idx", "10-K        ACME CORP\n            \n10-K405     B\n")
    assert sorted(map(tuple, S.fixed_width_index(spark, fixed).collect())) == [("10-K", "ACME CORP"), ("10-K405", "B")]
    labels = put("gold.csv", 'label,Content\nB1a,"x, y"\nI1a,z\nO,w\n')
    assert [(r.item, r.Content) for r in S.label_csv(spark, labels).orderBy("line").collect()] == [("1A", "x, y"), ("1A", "z"), (None, "w")]
    S.append_evidence(spark.createDataFrame([("r1", 1)], "run_id string, x int"), str(tmp_path / "audit"))
    S.append_evidence(spark.createDataFrame([("r1", 2), ("r2", 3)], "run_id string, x int"), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 3
    assert {len(r.sha256) for r in S.manifest(spark, str(tmp_path / "shots")).collect()} == {64}
