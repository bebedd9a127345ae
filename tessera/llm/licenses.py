"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are matched with the positions of the same k-grams in the templates by
a Spark join. A match votes for a diagonal: place in the document less place in the template. Votes are aggregated by
document, template and diagonal; neighbouring diagonals, a few inserted or missing words apart, are merged to one span
(but for the base phrases, whose words stand consecutively). The join also compares a second hash of the k-gram's words,
of 64 bits like the first, so a span counts only words that are really there. Its coverage is the share of the
template's k-grams that it holds. Templates may have any length.

A bitmap of the templates' hashes, of fixed size, is tested before rows leave the Python worker: it drops only k-grams
that cannot join. Every hit is a row of its own, so a text may hold any number of them. The templates are a fixed list
and are broadcast.

A null text is empty. Every input row gives one row, so repeated rows and equal ids are judged one by one. Texts are
read whole. An empty table gives an empty result. Other columns of the input are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import pieces, small_batches
from tessera.llm.words import alnum_bytes, grams, mix, row_words, spans, text_buffer, word_hashes

#: Phrases whose every place is counted, and their labels. Fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further templates: words of well-known license notices, and their labels.
OWN = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by 3 0": "cc-by",
    "creative commons attribution license": "cc-by",
    "cc0 1 0 universal": "cc0",
}
#: Whole license texts. Fixed values.
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
}
#: Share of a template's k-grams from which a span gives its label.
COVERAGE = 0.8
#: Merged diagonals may be as many words apart as a template has words for each of these, but no more than GAP.
APART, GAP = 4, 3
FILTER_BITS = 20


def gram_size(words: int) -> int:
    return min(3, words)


def phrase_words(phrase: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", phrase.lower())


def template_rows() -> list[tuple[int, int, str, bool, int, int, int, str]]:
    """(template, k, label, base, gap, number of k-grams, place, words of the k-gram)."""
    out = []
    own = [*((p, x, True) for p, x in BASE.items()), *((p, x, False) for p, x in OWN.items()), *((p, x, False) for x, p in TEXTS.items())]
    for t, (phrase, label, base) in enumerate(own):
        words = phrase_words(phrase)
        k = gram_size(len(words))
        places = range(len(words) - k + 1)
        gap = 0 if base else min(GAP, len(words) // APART)
        out += [(t, k, label, base, gap, len(places), i, " ".join(words[i : i + k])) for i in places]
    return out


def gram_pair(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of k words, given the words' hashes."""
    other = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return grams(hashes, k) ^ np.uint64(k), grams(other, k)


def gram_hashes(phrases: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of phrases of k words."""
    pairs = []
    for phrase in phrases:
        data, offsets = text_buffer(pa.array([phrase]))
        pairs.append([x[0] for x in gram_pair(word_hashes(data, *spans(data, offsets, alnum_bytes())), k)])
    return tuple(np.array(pairs, np.uint64).reshape(-1, 2).T)


def templates(spark: SparkSession) -> DataFrame:
    rows = [(*r[:7], *(int(x.view(np.int64)[0]) for x in gram_hashes([r[7]], r[1]))) for r in template_rows()]
    return spark.createDataFrame(
        rows, "template int, k int, label string, base boolean, gap int, parts int, place int, hash long, check long"
    )


HITS = "row long, doc_id long, n_words long, hash long, check long, at long"


def license_hits(docs: DataFrame) -> DataFrame:
    """A row for every row of (doc_id, text), without a hash, and one for each k-gram that can be in a template."""
    wanted = template_rows()
    sizes = sorted({r[1] for r in wanted})
    kept = {k: gram_hashes([r[7] for r in wanted if r[1] == k], k)[0] for k in sizes}
    names = [column.split()[0] for column in HITS.split(", ")]

    def rows(batches):
        low = np.uint64((1 << FILTER_BITS) - 1)
        maps = {}
        for k, hashes in kept.items():
            maps[k] = np.zeros(1 << FILTER_BITS, bool)
            maps[k][(hashes & low).astype(np.int64)] = True
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets = text_buffer(piece["text"])
                starts, ends = spans(data, offsets, alnum_bytes())
                hashes, bounds = word_hashes(data, starts, ends), row_words(starts, offsets)
                n = piece.num_rows
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), piece["doc_id"], pa.array(np.diff(bounds)), none, none, none], names)
                for k, chosen in maps.items():
                    # in stretches, whose windows overlap
                    for s in range(0, max(0, len(hashes) - k + 1), 1 << 18):
                        first, second = gram_pair(hashes[s : s + (1 << 18) + k - 1], k)
                        at = np.flatnonzero(chosen[(first & low).astype(np.int64)])
                        rows_at = np.searchsorted(bounds, s + at, "right") - 1
                        inside = s + at + k <= bounds[rows_at + 1]
                        at, rows_at = at[inside], rows_at[inside]
                        for i in range(0, len(at), 1 << 14):
                            a, r = at[i : i + (1 << 14)], rows_at[i : i + (1 << 14)]
                            columns = [pa.array(row + r), piece["doc_id"].take(pa.array(r)), pa.array(np.diff(bounds)[r])]
                            columns += [pa.array(first[a].view(np.int64)), pa.array(second[a].view(np.int64)), pa.array(s + a - bounds[r])]
                            yield pa.RecordBatch.from_arrays(columns, names)
                row += n

    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(rows, HITS)


def scan(docs: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (the highest coverage of a template)."""
    own = ["row", "doc_id", "n_words"]
    known = F.broadcast(templates(docs.sparkSession))
    votes = license_hits(docs).join(known, ["hash", "check"], "left")
    votes = votes.where("hash is null or template is not null").withColumn("diagonal", F.col("at") - F.col("place"))
    each = [*own, "template", "label", "base", "gap", "parts"]
    votes = votes.groupBy(*each, "diagonal").agg(F.collect_set("place").alias("places"))
    w = Window.partitionBy(*own, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > F.col("gap"), F.lit(True))
    spanned = votes.withColumn("apart", apart.cast("long"))
    spanned = spanned.withColumn("span", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a diagonal alone is a span, as nearly all are; merged ones count each place of the template once
    alone = F.size("places") / F.col("parts")
    merged = spanned.withColumn("place", F.explode("places")).groupBy(*each, "span").agg(
        F.count_distinct("place").alias("n"), F.min("diagonal").alias("first")
    )
    single = spanned.where("base or template is null").select(*each, F.when(F.col("template").isNotNull(), alone).alias("share"), F.col("diagonal").alias("first"))
    merged = merged.where("not base").select(*each, (F.col("n") / F.col("parts")).alias("share"), "first")
    spanned = single.unionByName(merged)
    place = F.col("base") & (F.col("share") == 1)
    found = place | (F.col("share") >= coverage)
    return spanned.groupBy(own).agg(
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("first"))).alias("first_word"),
        F.max(F.when(place, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).drop("row")


def scan_sql() -> str:
    """The same over a table `documents` in DuckDB."""
    rows = ", ".join(f"({t}, {k}, '{label}', {str(base).lower()}, {gap}, {parts}, {place}, '{words}')" for t, k, label, base, gap, parts, place, words in template_rows())
    return f"""
WITH known(template, k, label, base, gap, parts, place, words) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
spots AS (SELECT r, words, unnest(range(0, len(words))) AS spot FROM docs),
grams AS (SELECT r, spot, k, array_to_string(list_slice(spots.words, spot + 1, spot + k), ' ') AS words
    FROM spots, (SELECT DISTINCT k FROM known) WHERE spot + k <= len(spots.words)),
votes AS (SELECT DISTINCT r, template, label, base, gap, parts, spot - place AS diagonal, place
    FROM grams JOIN known USING (k, words)),
cuts AS (SELECT DISTINCT r, template, diagonal, gap FROM votes),
marks AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > gap OR lag(diagonal) OVER w IS NULL THEN 1 ELSE 0 END AS apart
    FROM cuts WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
runs AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marks),
spans AS (SELECT r, template, label, base, span, count(DISTINCT place)::DOUBLE / parts AS share,
    min(diagonal) AS first FROM votes JOIN runs USING (r, template, diagonal) GROUP BY r, template, label, base, parts, span)
SELECT doc_id, any_value(len(docs.words)) AS n_words,
    count(*) FILTER (WHERE base AND share = 1) AS n_base,
    min(first) FILTER (WHERE base AND share = 1) AS first_word,
    max(first) FILTER (WHERE base AND share = 1) AS last_word,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base AND share = 1)), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE (base AND share = 1) OR share >= {COVERAGE})), ','), '') AS labels,
    coalesce(max(share), 0.0) AS score
FROM docs LEFT JOIN spans USING (r) GROUP BY r, doc_id"""
