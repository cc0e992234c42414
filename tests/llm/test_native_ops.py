"""Mixing, sharding, licence scan, fingerprints: SQL parity and edge cases."""

import hashlib
import pathlib
import random
import re
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from seedgrow.llm import fracminhash, licenses, mixing, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df_rows):
    return sorted((tuple(r) for r in df_rows), key=repr)


def duck(sql, docs):
    import pandas as pd  # noqa: F401

    con = duckdb.connect()
    con.register("documents_pd", docs.toPandas())
    con.sql("CREATE VIEW documents AS SELECT * FROM documents_pd")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, one hot source."""
    rows = [
        (1, "one two three four five six seven", "en", "a", 1),
        (2, "one two three four five six seven", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "", 0),
        (5, "x " * 30000, "en", "a", 5),
        (6, "Émile 𝒳 wrote this", "fr", "b", 6),
        (7, " \t\n", "fr", "b", 6),
        (8, "a", "de", "c", 1),
        (9, "a b c d", "de", None, 1),
        (10, "a b c d e", "de", "é", 1),
    ] + [(20 + i, f"copy of a hot source number {i % 3}", "en", "hot", 9) for i in range(60)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize(
    "query,sql", [(mixing.op2_mix, mixing.op2_sql), (sharding.op3_shard, sharding.op3_sql),
                  (fracminhash.op8_fingerprint, fracminhash.op8_sql)], ids=["op2", "op3", "op8"])
def test_sql_parity_on_odd_rows(spark, odd, tmp_path, query, sql):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = query(spark, str(tmp_path))
    names, want = duck(sql(), odd)
    assert got.columns == names
    assert rows_of(got.collect()) == rows_of(want)


def test_empty_tables(spark, odd):
    e = odd.limit(0)
    assert mixing.draw(e).count() == mixing.mix(e).count() == sharding.assign_shards(e).count() == 0
    assert licenses.scan(e).count() == fracminhash.with_next(e).count() == 0


def test_clashing_columns_are_replaced(odd):
    d = odd.withColumns({"size": F.lit("x"), "target": F.lit("x"), "shard": F.lit("x"), "license": F.lit("x")})
    assert dict(mixing.draw(d).dtypes)["size"] == "bigint"
    assert dict(sharding.assign_shards(d).dtypes)["shard"] == "string"
    assert licenses.scan(d).where("license = 'x'").count() == 0


def test_targets_stop_at_twice_the_source_and_share_the_rest():
    """Water-filling by repeated resharing, against the closed form."""
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 500, "e": 500, "f": 0}
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    total, target, capped = 1.5 * sum(sizes.values()), {}, {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        target = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s: 2.0 * sizes[s] for s in free if target[s] > 2 * sizes[s]}
        if not over:
            break
        capped.update(over)
    target.update(capped)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents AS SELECT range AS doc_id, s AS source, repeat('w ', n) AS text FROM "
            f"(VALUES {','.join(f'({i},{s!r},{n})' for i, (s, n) in enumerate(sizes.items()))}) t(range, s, n)")
    got = dict(con.sql(f"SELECT source, target FROM ({mixing.op2_sql()}) JOIN documents USING (doc_id)").fetchall())
    assert got == pytest.approx(target)


def test_mixture_meets_its_targets(spark):
    d = mixing.op2_mix(spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source"), "doc_id")
    r = d.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.sum("size").alias("s")).collect()
    assert sum(x["t"] for x in r) == pytest.approx(1.5 * sum(x["s"] for x in r), rel=0.03)
    assert all(abs(x["t"] - x["g"]) < 0.2 * x["g"] for x in r)
    assert d.where("taken > 2 * size").count() == 0


def test_mix_emits_rows_as_often_as_drawn(odd):
    drawn = {r["doc_id"]: r["copies"] for r in mixing.draw(odd).collect()}
    emitted = mixing.mix(odd)
    assert emitted.columns == odd.columns
    got = {r["doc_id"]: r["count"] for r in emitted.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in drawn.items() if v}


def test_shards_fit_and_copies_are_cut(spark, tmp_path):
    rows = [(i, "t" * (i % 40), "en", "s", 1) for i in range(400)] + [(7, "same text " * 10, "en", "s", 1)] * 90
    rows += [(900, "long " * 1000, "en", "s", 1), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    out = sharding.assign_shards(d, 1000)
    assert out.count() == len(rows)
    size = out.groupBy("shard").agg(F.sum("doc_bytes").alias("b"), F.count("*").alias("n"), F.max("shard_bytes").alias("s"))
    for r in size.collect():
        assert r["b"] == r["s"] and (r["b"] <= 1000 or r["n"] == 1)
    assert out.where("doc_id = 7 and doc_bytes = 100").select("shard").distinct().count() == 9
    # Prefixes partition the hash space: no shard is a prefix of another's.
    names = sorted({r["shard"].split("/")[0] for r in size.collect()})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    sharding.write_shards(d, str(tmp_path / "s"), 1000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


@pytest.mark.parametrize("text,name", [
    ("Released under the MIT License.", "MIT"),
    ("  RELEASED under the mit licence ", "MIT"),
    ("Copyright (c) 2020 Somebody\nLicensed under the Apache License, version 2.0", "Apache-2.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Some story. Released under the MIT License.", None),
    (None, None), ("", None), ("Copyright 2020 me", None),
])
def test_whole_text_licences(spark, text, name):
    d = spark.createDataFrame([(1, text, None, None, None)], DOCS)
    assert licenses.scan(d).first()["license"] == name


def test_full_licence_texts_and_lines(spark):
    for name, t in licenses.KNOWN:
        assert licenses.known_digests()[hashlib.sha256(licenses.canonical_py(t).encode()).hexdigest()] == name
    body = next(t for n, t in licenses.KNOWN if t.startswith("MIT License"))
    filled = body.replace("<year> <holder>", "2019 Jane Doe").replace("sublicense", "sublicence").lower()
    d = spark.createDataFrame(
        [(1, filled, None, None, None), (2, "Tale.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", None, None, None)], DOCS)
    got = {r["doc_id"]: (r["license"], r["line_licenses"], r["n_license_lines"]) for r in licenses.scan(d).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, "CC-BY-NC-4.0,MIT", 2)


def test_whole_documents_of_each_licence(spark):
    """Shipped texts, filled in and wrapped anew; statements over two lines."""
    texts = {}
    for f in sorted((pathlib.Path(licenses.__file__).parent / "license_texts").glob("*.txt")):
        texts[f.name] = (f.name.removesuffix(".txt").removesuffix(".spdx"), f.read_text())
    bsd3 = texts["BSD-3-Clause.txt"][1].split("\n", 2)[2]
    mit = next(t for _, t in licenses.KNOWN if t.startswith("MIT License"))
    cases = [*texts.values(), ("MIT", mit.split("\n", 2)[2]), ("MIT", "The MIT License (MIT)\n\n" + mit.split("\n", 1)[1])]
    for name, t in texts.values():
        paragraphs = [x if re.search(r"copyright \(c\)|copyright ©", x[:300], re.I) else textwrap.fill(x, 61) for x in re.split(r"\n\s*\n", t)]
        cases.append((name, "\n\n".join(paragraphs)))
    acme = bsd3.replace("the University", "Acme Inc.").replace("THE REGENTS AND CONTRIBUTORS", "ACME INC. AND OTHERS")
    cases += [("BSD-3-Clause", "Copyright (c) 2020 Acme\n" + acme), ("BSD-3-Clause", "BSD 3-Clause License\nCopyright 2020, A\n" + bsd3)]
    cases += [("Apache-2.0", texts["Apache-2.0.txt"][1].split("APPENDIX")[0]), (None, bsd3.replace("binary", "source")), (None, bsd3 + " and more")]
    d = spark.createDataFrame([(i, t, None, None, None) for i, (_, t) in enumerate(cases)], DOCS)
    got = {r["doc_id"]: r["license"] for r in licenses.scan(d).collect()}
    assert [(i, got[i]) for i in range(len(cases))] == [(i, n) for i, (n, _) in enumerate(cases)]
    wrapped = "Tale.\nThis project is licensed\r\nunder the\nMIT License.\nReleased under the MIT\n\nLicense.\nCopyright 2020 me\nLicensed under CC BY 4.0."
    r = licenses.scan(spark.createDataFrame([(1, wrapped, None, None, None)], DOCS)).first()
    assert (r["license"], r["line_licenses"], r["n_license_lines"]) == (None, "CC-BY-4.0,MIT", 2)


def test_license_lines_of_the_table(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    known = licenses.known_digests()
    want = {}
    for i, text in zip(t.doc_id, t.text):
        found = [known.get(hashlib.sha256(licenses.canonical_py(x).encode()).hexdigest()) for x in text.split("\n")]
        want[i] = ",".join(sorted({x for x in found if x}))
    got = {r["doc_id"]: r["line_licenses"] for r in licenses.op6_license(spark, SF).collect()}
    assert got == want and any(want.values())


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:200]), " ".join(words[196:]), " ".join(words), "too short"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    s = {r["doc_id"]: r["fingerprint_hashes"] for r in fracminhash.fingerprint(d).collect()}
    both = spark.createDataFrame([(s[0], s[1])], "a array<bigint>, b array<bigint>")
    assert both.select(fracminhash.merge(F.col("a"), F.col("b"))).first()[0] == s[2]
    assert len(s[3]) == 1
    want = {hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:15] for i in range(396)}
    assert set(s[2]) == {int(h, 16) for h in want if h < "2"}


def test_licences_without_limits(spark):
    """Long holders, statements over many lines, identifiers and names by table."""
    body = (pathlib.Path(licenses.__file__).parent / "license_texts" / "BSD-3-Clause.txt").read_text().split("\n", 2)[2]
    holder = "the very long named institute of " + "many words and " * 60 + "others"
    long_name = body.replace("the University", holder).replace("THE REGENTS AND CONTRIBUTORS", holder.upper())
    whole = {
        "Licensed under the GNU General Public License, version 2.": "GPL-2.0-only", "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1-only",
        "This program is licensed under the MIT license": "MIT", "The software is released under the Mozilla Public Licence 2.0": "MPL-2.0",
        long_name: "BSD-3-Clause", "SPDX-License-Identifier: nothing": None, "we are licensed under the MIT license": None,
    }
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(whole)], DOCS)
    assert [r["license"] for r in licenses.scan(d).orderBy("doc_id").collect()] == list(whole.values())
    one = next(t for n, t in licenses.KNOWN if n == "Apache-2.0" and "compliance" in t)
    lines = {
        "\n".join("This work is licensed under the GNU General Public License , version 3".replace(" ,", ",").split()): ("GPL-3.0-only", 1),
        "tale\n" + "\n".join(one.split()) + "\nend": ("Apache-2.0", 1),
        "This\nwork\n\nis licensed under CC0 1.0": ("", 0), "x Licensed under\nCC BY 4.0": ("", 0), "Licensed under\nCC BY 4.0 x": ("", 0),
        "Licensed under CC BY 4.0\nLicensed\nunder CC BY-SA\n4.0\nSPDX-License-Identifier: MIT": ("CC-BY-4.0,CC-BY-SA-4.0,MIT", 3),
        "in no event shall " * 20000 + "software is provided by " * 20000: ("", 0), "licensed under\n" * 50000: ("", 0),
    }
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(lines)], DOCS)
    got = [(r["line_licenses"], r["n_license_lines"]) for r in licenses.scan(d).orderBy("doc_id").collect()]
    assert got == list(lines.values())


def test_statement_pattern_finds_what_line_runs_hold(spark):
    """Against a plain search of all runs of lines."""
    rng = random.Random(11)
    known = {licenses.canonical_py(t): n for n, t in [*licenses.KNOWN, *licenses.statements()]}
    some = [t for t in sorted(known) if len(t) < 90]
    texts = []
    for _ in range(150):
        words = []
        for t in rng.sample(some, 3):
            words += [w + rng.choice([" ", " ", " ", "\n"]) for w in t.split()] + [rng.choice(["\n", "\n", "\n\n", " x "])]
        texts.append("".join(words))
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = [r["line_licenses"] for r in licenses.scan(d).orderBy("doc_id").collect()]
    for text, found in zip(texts, got):
        lines, want, i = [" ".join(x.split()) for x in text.split("\n")], set(), 0
        while i < len(lines):
            ends = [j for j in range(i + 1, len(lines) + 1) if all(lines[i:j]) and " ".join(lines[i:j]) in known]
            if ends:
                want.add(known[" ".join(lines[i : max(ends)])])
            i = max(ends) if ends else i + 1
        assert found == ",".join(sorted(want))
