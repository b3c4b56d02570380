"""The registered queries, as they are, over a small table, against plain forms and their own SQL."""

import random
import re
import zlib

import duckdb
import pytest

from steadfast.llm import html_consensus, license_scan, pii_crf
from steadfast.llm.queries import QUERIES, SQL

from . import brute
from .test_texts import PAGE, plain_base, some_texts

NOTICES = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "All rights reserved."]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    r = random.Random(21)
    texts = some_texts(21, 40, [f"w{i}" for i in range(60)])
    texts += [t + "\n" + r.choice(NOTICES) for t in texts[:8]] + [t.replace("w1 ", "x.y@z.org ", 1).replace("w2 ", "10.0.0.1 ", 1) for t in texts[8:14]]
    texts += [None, "", "+1 (743) 555-3824 4111 1111 1111 1111", "w " * 400, texts[0]]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    pages = [(i, f"http://www.example.org/{x}/{i}?q", PAGE) for i, x in enumerate(["es", "en", "fr"])] + [(9, None, None), (10, "https://a.com/de/1", "<p>only text")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path), {i: t for i, t, *_ in rows}


def run(spark, folder, name):
    return {r[0]: r for r in QUERIES[name](spark, folder[0]).collect()}


def test_op1(spark, folder):
    got = run(spark, folder, "op1_license_scan")
    names = {text: name for name, text in license_scan.TEMPLATES}
    for i, t in folder[1].items():
        want = [f"{names[n]}:{m.start()}:{m.end() - 1}" for n in NOTICES for m in re.finditer(re.escape(n), t or "")]
        assert [":".join(x.split(":")[:3]) for x in got[i]["licenses"].split(",") if x] == want and got[i]["n_licenses"] == len(want)


def test_op2(spark, folder):
    import tiktoken

    from steadfast.llm.byte_bpe import read_ranks, vocabulary

    path, pattern = vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(open(path, "rb").read()), special_tokens={})
    for i, r in run(spark, folder, "op2_byte_bpe").items():
        ids = enc.encode_ordinary(folder[1][i] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(folder[1][i] or ""))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{folder[0]}/{t}.parquet/*.parquet')")
    theirs = con.execute(SQL[name]).df()
    ours = QUERIES[name](spark, folder[0]).toPandas()[list(theirs.columns)]
    order = lambda d: sorted(map(tuple, d.astype(object).where(d.notna(), None).itertuples(index=False)), key=str)
    assert order(ours) == order(theirs)


def test_op4(spark, folder):
    for i, r in run(spark, folder, "op4_quality_rules").items():
        assert tuple(r)[1:] == brute.quality(folder[1][i])


def test_op6(spark, folder):
    wanted, sizes = brute.components({i: t or "" for i, t in folder[1].items()}, 3, 90)
    got = run(spark, folder, "op6_jaccard_join")
    assert {i: r["component_id"] for i, r in got.items()} == wanted and {i: r["n_shingles"] for i, r in got.items()} == sizes


def test_op8(spark, folder):
    for i, r in run(spark, folder, "op8_mpeg_audio").items():
        raw = (folder[1][i] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-64:]))
        media, frames = brute.audio(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), brute.sha(media))
        assert f"layer=3;rate=32000;channels=1;frames={frames};samples={1152 * frames};" in r["feature"] and f"crc_ok={frames + 1};crc_bad=0;junk=0;" in r["feature"]


def test_op9(spark, folder):
    kinds = ("email", "ip", "card", "phone")
    for i, r in run(spark, folder, "op9_pii_crf").items():
        base = plain_base(folder[1][i] or "")
        written = [f"{kinds[k]}:{a}:{b}" for a, k, b in base]
        assert [r[f"n_{k}"] for k in kinds] == [sum(x == n for _, x, _ in base) for n in range(4)] and r["base_sha256"] == brute.sha(",".join(written))
        assert set(written) <= set(r["spans"].split(",") if r["spans"] else [])


def test_op9_spans_by_plain_decoding(spark, folder):
    import numpy as np

    field = pii_crf.Field(*pii_crf.default_field())
    for i, r in run(spark, folder, "op9_pii_crf").items():
        text, at = folder[1][i] or "", 0
        spans = plain_base(text)
        taken = [(a, b) for a, _, b in spans]
        for line in text.split("\n"):
            words = [(m[0], at + m.start(), at + m.end()) for m in brute.WORD.finditer(line)]
            at += len(line) + 1
            if not words:
                continue
            ids = [field.edge, *(field.number(w.encode()) for w, _, _ in words), field.edge]  # every line, without the bound
            e = np.array([field.own[b] + field.left[a] + field.right[c] for a, b, c in zip(ids, ids[1:], ids[2:], strict=False)])
            labels = field.viterbi(e[None], np.array([len(words)]))[0].tolist()
            k = 0
            while k < len(labels):
                j = next((j for j in range(k, len(labels)) if labels[j] != labels[k]), len(labels))
                if labels[k]:
                    a, b = words[k][1], words[j - 1][2]
                    b -= len(text[a:b]) - len(text[a:b].rstrip(".,;:!?\"'>|#*%&$"))
                    a += len(text[a:b]) - len(text[a:b].lstrip("\"'<|"))
                    name = pii_crf.LABELS[labels[k]]
                    if a < b and pii_crf.plausible(name, text[a:b]) and all(b <= x or y <= a for x, y in taken):
                        spans.append((a, pii_crf.KINDS.index(name), b))
                k = j
        assert r["spans"] == ",".join(f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)), text


def test_op1_against_all_templates_on_whole_texts(spark, folder):
    r = random.Random(4)
    names = [(n, t) for n, t in license_scan.TEMPLATES]
    scanner = license_scan.Scanner()
    templates = [t for group in scanner.classes.values() for t in group]
    texts = [t or "" for t in folder[1].values()] + [" thth onre ".join(r.choice(names)[1].replace("<holder>", "Acme") for _ in range(r.choice([1, 2, 3]))) for _ in range(20)]
    for text in texts:
        words = [(m[0].lower(), m.start(), m.end()) for m in license_scan.WORD.finditer(text)]
        found = {(words[a][1], words[b][2], t.name, len(d)) for t in templates for a, b, d in license_scan._confirm(t.words, [w for w, _, _ in words])}
        kept = []
        for x in sorted(found, key=lambda x: (x[0] - x[1], x[3], x[2])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                kept.append(x)
        assert [(a, b, n, k) for a, b, n, _, k, _ in scanner.scan(text)] == sorted(kept), text


def test_op10(spark, folder):
    got = run(spark, folder, "op10_html_consensus")
    assert got[0]["text"] == got[2]["text"] == "Head &amp; tail\nOne two three\nFour five six.\na\nb" and got[9]["text"] == "" and got[10]["text"] == "only text"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_op10_votes_by_plain_counting(spark, tmp_path):
    r = random.Random(9)
    rows = []
    for i in range(60):
        host = r.choice(["a.org", "b.org", "c.org"])
        boxes = [f"<div class='{c}{i}'>" + "<p>some running text in here</p>" * r.choice([1, 3, 9]) + "</div>" for c in ("alpha", "beta", "gamma")]
        rows.append((i, f"http://{host}/{i}", "<body>" + "".join(r.sample(boxes, r.choice([1, 2, 3]))) + "</body>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    parsed = {i: html_consensus.parse(x) for i, _, x in rows}
    won = brute.winners([(u.split("/")[2], parsed[i]) for i, u, _ in rows], html_consensus.scores)
    want = {i: html_consensus.extract(parsed[i], won[u.split("/")[2]]) for i, u, _ in rows}
    got = {x["page_id"]: x["text"] for x in QUERIES["op10_html_consensus"](spark, str(tmp_path)).collect()}
    assert got == want
    alone = {i: html_consensus.extract(parsed[i], None) for i, _, _ in rows}
    assert sum(alone[i] != want[i] for i in want) > 5  # without the votes the pages would choose otherwise
