"""Indexes into bound reports and bodies that stand elsewhere: every document laid out as a filing against plain versions, and known answers."""

import difflib
import re
import statistics

import pytest

from spanforge.functions.sequences import page_run_places
from spanforge.operators import indexes as X
from spanforge.operators import wrappers as W
from spanforge.operators.sections import ITEMS, candidates, sections

SF = "/root/testdata/sf0.001"
ORDER = [c for c, _ in ITEMS]
TITLES = dict(ITEMS)


def lines(text):
    at = 0
    for line in text.split("\n"):
        yield at, at + len(line), line
        at += len(line) + 1


def page_map(text, lo=0, hi=1 << 62):
    feet = [(a, b, int(t)) for a, b, t in lines(text) if lo <= a < hi and re.fullmatch(r"\s*\d{1,4}\s*", t)]
    run = [feet[i] for i in page_run_places([f[2] for f in feet])]
    return {p: a for a, _, p in run}, {p: b for _, b, p in run}


def ranges_of(pages, ref):
    starts, ends = pages
    if not starts or max(starts) - min(starts) < 5:
        return []
    found = [(int(a), int(b)) for a, b in re.findall(r"(\d{1,4})\s*[-–]\s*(\d{1,4})", ref)] or [(int(n),) * 2 for n in re.findall(r"\d{1,4}", ref)]
    out = []
    for a, b in sorted(((a, min(b, max(starts))) for a, b in found if min(starts) <= a <= max(starts)), key=lambda r: (r[0], -r[1])):
        start, end = ends.get(a - 1) or starts.get(a), starts.get(b) or ends.get(b)
        if start is not None and end is not None and end > start:
            out.append((start, end, a, b))
    return out


def alike(a, b):
    return difflib.SequenceMatcher(None, a.casefold(), b.casefold()).ratio()


def plain_index(text, heads):
    """{code: (start, end, ref, says none)} or None; heads: (code, start, end) in order."""
    filled = [(a, b, t.strip()) for a, b, t in lines(text) if t.strip()]
    if len(heads) >= 8:
        windows = [(len({c for c, s, _ in heads if 0 <= s - lo <= 8000}), lo, max(e for _, s, e in heads if 0 <= s - lo <= 8000)) for _, lo, _ in heads]
        n, lo, hi = max(windows, key=lambda w: w[0])
        inside = [h for h in heads if lo <= h[1] <= hi]
        if n < 8 or len({c for c, s, _ in heads if not lo <= s <= hi}) >= 3:
            return None
        out = {}
        for k, (code, start, end) in enumerate(inside):
            after = next(((b, t) for a, b, t in filled if a >= end), (end, ""))
            stop = inside[k + 1][1] if k + 1 < len(inside) else min(hi + 1, len(text))
            refs = re.findall(r"pages?\s+\d[\d,\s\-–]*", text[end : max(end, stop)], re.I)
            if not refs and (m := re.search(r"(\d{1,4}(?:\s*[-–]\s*\d{1,4})?)\s*$", text[start:end])):
                refs = [m[1]]
            ref = "; ".join(r.strip() for r in refs)
            if code not in out:
                out[code] = [start, after[0] if re.match(X.PAGE_LINE, after[1]) else end, ref, bool(re.match(X.NO_CONTENT, after[1]))]
            out[code][2] = out[code][2] or ref
        gaps = [b[1] - a[1] for a, b in zip(inside, inside[1:])]
        return out if sum(bool(v[2]) for v in out.values()) / n >= 0.25 or statistics.median(gaps) <= 300 else None
    hits = [(a, b, m[1].upper(), m[2].strip(), (m[3] or "").strip()) for a, b, t in lines(text) if (m := re.match(X.BARE_ENTRY, t))]
    hits = [h for h in hits if h[2] in TITLES and alike(h[3], TITLES[h[2]]) >= 0.5]
    hits = [h for h in hits if h[0] - hits[0][0] <= 24_000]
    if len({h[2] for h in hits}) < 8:
        return None
    out = {}
    for a, b, code, title, ref in hits:
        out.setdefault(code, [a, b, "", bool(re.match(X.NO_CONTENT, ref or title))])
        out[code][2] = out[code][2] or ref
    return out


def plain_segments(text, index):
    pages, claimed, out = page_map(text), set(), {}
    for code in ORDER:
        start, end, ref, none = index.get(code, (0, 0, "", False))
        free = [r for r in ranges_of(pages, ref) if r[:2] not in claimed]
        merged = []
        for a, b, *_ in sorted(free):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        total, count = sum(b - a for a, b in merged), len({p for *_, a, b in free for p in range(a, b + 1)})
        if ref and free and free[0][1] - free[0][0] >= 20_000:
            claimed.add(free[0][:2])
            out[code] = ("partial", "resolved_from_page_anchor", *free[0][:2], ())
        elif ref and total > 400 and not (count >= 3 and total < 300 * count):
            claimed.update(merged)
            out[code] = ("partial", "resolved_from_page_anchor", merged[0][0], merged[-1][1], tuple(merged) if len(merged) > 1 else ())
        elif ref:
            out[code] = ("unsupported", "unresolved", start, end, ()) if total > 400 else ("incorporated_by_reference", "cross_reference_pointer", start, end, ())
        elif code == "6":
            out[code] = ("reserved", "offset_exact_span", 0, 0, ())
        elif none or code not in index:
            out[code] = ("missing", "unresolved", 0, 0, ())
        else:
            out[code] = ("incorporated_by_reference", "cross_reference_pointer", start, end, ())
    return out


def segments_of(spark, docs):
    """(rows of the operator, rows of the plain version) by document."""
    found = candidates(docs)
    heads = {}
    for r in sorted(found.collect(), key=lambda r: (r.start, r.ord)):
        heads.setdefault(r.doc_id, []).append((r.code, r.start, r.end))
    got = {}
    for r in X.index_segments(docs, X.indexes(docs, found)).collect():
        assert r.needs_review == (r.status != "reserved")
        got.setdefault(r.doc_id, {})[r.code] = (r.status, r.provenance, r.start, r.end, tuple((s.start, s.end) for s in r.ranges))
    want = {}
    for r in docs.collect():
        index = plain_index(r.text or "", heads.get(r.doc_id, []))
        if index is not None:
            want[r.doc_id] = plain_segments(r.text, index)
    return got, want


def test_index_segments_of_all_documents(spark):
    got, want = segments_of(spark, X._indexed(spark, SF))
    assert got == want and len(got) == 200
    assert {s[:2] for d in got.values() for s in d.values()} == {
        ("partial", "resolved_from_page_anchor"), ("unsupported", "unresolved"), ("incorporated_by_reference", "cross_reference_pointer"), ("reserved", "offset_exact_span"), ("missing", "unresolved"),
    }


PAGES = "".join(f"Text of page {n}. " + "words go on " * 60 + f"\n{n}\n" for n in range(1, 60))
NAMED = [(c, t) for c, t in ITEMS if c in "1 1A 2 3 5 6 7 7A 8 9".split()]


def test_index_segments_known(spark):
    refs = {"1": "Pages 3-5", "1A": "Pages 3-5", "2": "Pages 3-5, 8-9", "3": "Pages 30-58", "5": "Pages 700", "6": "", "7": "Pages 10-11, 20-21", "7A": "None.", "8": "see elsewhere", "9": "Page 12"}
    entries = "".join(f"Item {c}. {t}\n{refs[c]}\n" for c, t in NAMED)
    bodies = "".join(f"Item {c}. {t}\n" + "We say much here. " * 160 + "\n" for c, t in NAMED)
    packed = "".join(f"Item {c}. {t}\nword\n" for c, t in NAMED)
    bare = "".join(f"{c}.{t}{refs[c].removeprefix('Pages ') if refs[c].startswith('Pages') else ''}\n" for c, t in NAMED)
    texts = {1: entries + PAGES, 2: "".join(f"Item {c}. {t}\n" for c, t in NAMED) + bodies, 3: packed, 4: bare + PAGES, 5: entries[:200], 6: bodies, 7: None, 8: "", 9: packed.replace("\nword", "") + PAGES}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got, want = segments_of(spark, docs)
    assert got == want and sorted(got) == [1, 3, 4, 9]  # a table of contents before bodies, and bodies alone, are no index
    one, text = got[1], texts[1]
    body = lambda code: text[one[code][2] : one[code][3]]
    assert body("1").startswith("\nText of page 3.") and body("1").endswith("\n") and "Text of page 5." in body("1") and "Text of page 6." not in body("1")
    assert one["1A"][0] == "incorporated_by_reference" and body("1A") == f"Item 1A. {TITLES['1A']}\nPages 3-5"  # the one range is taken
    assert body("2").startswith("\nText of page 8.") and one["2"][4] == ()
    assert one["3"][3] - one["3"][2] > 20_000 and "Text of page 58." in body("3")
    assert one["5"][0] == "incorporated_by_reference" and one["6"][0] == "reserved" and one["7A"][0] == one["16"][0] == "missing" and one["8"][1] == "cross_reference_pointer"
    assert len(one["7"][4]) == 2 and text[slice(*one["7"][4][1])].startswith("\nText of page 20.")
    assert {s[0] for s in got[3].values()} == {"incorporated_by_reference", "reserved", "missing"}
    assert got[4]["3"][0] == "partial" and got[4]["9"][0] == "incorporated_by_reference"
    sparse = docs.where("doc_id = 1").selectExpr("doc_id", r"regexp_replace(text, '(words go on )+', 'a few words that go on here and there, up to a hundred') as text")
    assert segments_of(spark, sparse)[0][1]["3"][:2] == ("unsupported", "unresolved")


def norm(s):
    return re.sub(r"\s+", " ", s.replace("’", "'").strip()).lower()


def plain_tops(text, markers, lo, hi):
    """(line index, start, title) of the headings that pages begin with, and where the text before a line ends."""
    rows = [(a, b, t.strip()) for a, b, t in lines(text)]
    at = {a: k for k, (a, _, _) in enumerate(rows)}
    marks = [at[m] for m in sorted(markers) if lo <= m < hi]
    seen = {}
    for k in marks:
        near = {re.sub(r"\d+", "", norm(rows[j][2])) for j in range(max(0, k - 2), min(len(rows), k + 7)) if j != k and rows[j][2] and len(rows[j][2]) <= 80 and not re.fullmatch(r"\d{1,4}", rows[j][2])}
        for key in near:
            seen[key] = seen.get(key, 0) + 1
    furniture = {key for key, n in seen.items() if n >= 3}
    odd = lambda t: bool(re.fullmatch(r"\d{1,4}", t)) or re.sub(r"\d+", "", norm(t)) in furniture
    tops = set()
    for k in marks:
        following = [j for j in range(k + 1, len(rows)) if rows[j][2]][:6]
        first = next((j for j in following if not odd(rows[j][2])), None)
        if first is not None and len(rows[first][2]) <= 60:
            tops.add(first)

    def body_end(k):
        end = rows[k][0]
        while k and (not rows[k - 1][2] or re.fullmatch(r"\d{1,4}", rows[k - 1][2]) or (len(rows[k - 1][2]) <= 80 and odd(rows[k - 1][2]))):
            k -= 1
            end = rows[k][0]
        return end

    return [(k, rows[k][0], rows[k][2]) for k in sorted(tops) if lo <= rows[k][0] < hi], body_end


def plain_anchor(text, start, title):
    rows = [(a, t.strip()) for a, _, t in lines(text)]
    for k, (a, t) in enumerate(rows):
        if a < start or t.lower().replace("’", "'") != title.lower().replace("’", "'"):
            continue
        short = []
        for _, x in rows[k + 1 : k + 12]:
            if len(x) >= 80 or len(short) == 4:
                break
            if x:
                short.append(x)
        if sum(bool(re.fullmatch(r"\d{1,4}", x)) for x in short) < 2:
            return a
    return None


def plain_bodies(text, segs):
    """{code: (start, end, provenance)} of the pointers in segs {code: (status, start, end)} whose body is in the text."""
    out = {}
    region = max((e for _, _, e in segs.values() if e is not None), default=0)
    stubs = {c: text[a:b] for c, (status, a, b) in segs.items() if status == "incorporated_by_reference" and a is not None and not re.search("proxy\\s+statement", text[a:b], re.I)}
    if region and len(text) - region >= 20_000:
        pages, plans, found = page_map(text, region), {}, []
        for code, stub in stubs.items():
            if not re.search(W.THIS_FILING, stub):
                continue
            if m := re.search(W.STUB_PAGES, stub):
                spans = ranges_of(pages, m[1])
                if spans and spans[0][1] - spans[0][0] > 400:
                    plans[code] = spans[0][:2]
            elif (m := re.search(W.STUB_SECTION, stub)) and (a := plain_anchor(text, region, m[1])) is not None:
                plans[code] = (a, None)
                found.append(a)
        found += [a for t in W.ENDING_TITLES if (a := plain_anchor(text, region, t)) is not None]
        for code, (start, end) in plans.items():
            how = "resolved_from_page_anchor" if end is not None else "resolved_from_section_anchor"
            if end is None:
                end = min((a for a in found if a > start), default=len(text))
            else:
                tops, body_end = plain_tops(text, pages[0].values(), start, len(text))
                best = max(((alike(norm(TITLES[code]), norm(t)), -a) for _, a, t in tops if start < a < end), default=(0, 0))
                if best[0] >= 0.75:
                    off = -best[1]
                    later = next((k for k, a, _ in tops if a > off), None)
                    cut = body_end(later) if later is not None else -1
                    new = cut if off < cut <= end else end
                    if new - off > 400:
                        start, end = off, new
            if end - start > 400:
                out[code] = (start, end, how)
    now = {c: ("partial", *out[c][:2]) if c in out else s for c, s in segs.items()}
    for code, stub in stubs.items():
        m = re.search(W.OTHER_ITEM, stub)
        if code in out or not m or m[2].upper() == code or (lo := now[m[2].upper()][1]) is None or (hi := now[m[2].upper()][2]) - lo <= 400:
            continue
        starts, _ = page_map(text, lo, hi)
        if not starts or max(starts) - min(starts) < 5:
            continue
        tops, body_end = plain_tops(text, starts.values(), lo, hi)
        k = next((k for k, (_, _, t) in enumerate(tops) if norm(t) == norm(re.split(r"\s+[-–—]\s+", m[1])[-1])), None)
        if k is None:
            continue
        title, own = norm(tops[k][2]), norm(TITLES[code])
        if alike(own, title) < 0.5 and not set(re.findall("[a-z]{6,}", own)) & set(re.findall("[a-z]{6,}", title)):
            continue
        end = body_end(tops[k + 1][0]) if k + 1 < len(tops) else hi
        if end - tops[k][1] > 400:
            out[code] = (tops[k][1], end, "resolved_from_section_anchor")
    return out


def bodies_of(spark, docs):
    before = {(r.doc_id, r.code): r for r in sections(docs).collect()}
    after = {(r.doc_id, r.code): r for r in W.with_bodies(docs, sections(docs)).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(before) == set(after)
    got, want = {}, {}
    for key, r in after.items():
        if r.provenance.startswith("resolved"):
            assert r.status == "partial" and r.needs_review and r.body_chars == r.end_offset - r.start_offset
            got.setdefault(key[0], {})[key[1]] = (r.start_offset, r.end_offset, r.provenance)
        else:
            assert (r.status, r.start_offset, r.end_offset, r.body_chars, r.toc_listed) == before[key][2:]
    for d, text in texts.items():
        if found := plain_bodies(text, {c: tuple(before[d, c][2:5]) for c in ORDER}):
            want[d] = found
    return got, want


def test_bound_bodies_of_all_documents(spark):
    got, want = bodies_of(spark, W._wrapped(spark, SF))
    assert got == want
    assert sum("7A" in d for d in got.values()) > 10 and sum("8" in d for d in got.values()) > 10 and sum("1C" in d for d in got.values()) > 50


PROSE = "\n".join(["This is what the company has to say on this, and it says it at length. " * 2] * 6)


@pytest.fixture(scope="module")
def wrapper():
    heads = {51: "Operations", 53: "Quantitative and Qualitative Disclosures of Market Risk", 56: "Liquidity", 58: "Financial Notes"}
    pages = "".join(f"{heads[n]}\n{PROSE}\n{n}\nACME Annual Report {n + 1}\n\n" if n in heads else f"{PROSE}\n{n}\nACME Annual Report {n + 1}\n\n" for n in range(46, 76))
    inner = "".join(f"{'Cyber risk and Cybersecurity' + chr(10) if n == 5 else 'Other things' + chr(10) if n == 7 else ''}{PROSE}\n{n}\nACME 10-K\n" for n in range(1, 12))
    return (
        "Item 1C. Cybersecurity\nSee “MD&A - Risk - Cyber Risk and Cybersecurity” in Part II, Item 7 of this Form 10-K.\n"
        f"Item 7. Management's Discussion\n{inner}Item 7A. Market Risk\nThe details appear on pages 52-57 of the Financial Section.\n"
        'Item 8. Financial Statements\nSee the section entitled "Financial Notes" in the Annual Report.\nItem 9B. Other Information\nSee Note 4 on page 900 of the annual report.\n'
        "Item 11. Executive Compensation\nIncorporated by reference to the proxy statement, pages 47-49.\nSIGNATURES\nsigned\nFinancial Notes\n58\nSignatures\n75\n" + pages + "Signatures\n" + PROSE
    )


def test_bound_bodies_known(spark, wrapper):
    short = wrapper[: wrapper.index("SIGNATURES") + 3000]
    docs = spark.createDataFrame([(1, wrapper), (2, short), (3, None), (4, ""), (5, wrapper.replace("Cyber Risk and Cybersecurity”", "Risk”"))], "doc_id long, text string")
    got, want = bodies_of(spark, docs)
    assert got == want and set(got) == {1, 2, 5}
    text = {c: wrapper[a:b] for c, (a, b, _) in got[1].items()}
    assert set(got[1]) == {"1C", "7A", "8"} and set(got[2]) == {"1C"} and set(got[5]) == {"7A", "8"}
    assert text["1C"].startswith("Cyber risk and Cybersecurity\nThis is") and text["1C"].endswith("at length. \n") and text["1C"].count("This is") == 24
    assert text["7A"].startswith("Quantitative and Qualitative Disclosures of Market Risk\n") and text["7A"].endswith("at length. \n") and "Liquidity" not in text["7A"]
    assert text["8"].startswith("Financial Notes\nThis is") and text["8"].endswith("at length. ") and "Signatures" in text["8"]  # the first line of that name stands before


def test_bodies_are_found_where_a_document_is_read(spark):
    """Texts are five times the input here, so no row of them may be shuffled."""
    plan = W.d10_d11_d12_bound_bodies(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
