"""License scanning by diagonal voting: word k-grams of documents meet template positions in a join, and hits that
share an offset vote for a passage of the template."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noctua.llm.common import WORDY, Lookup, Words, chunks, run_hashes, word_hash, written

# Phrases that name a license, and the paragraphs of the short licenses (MIT, BSD, ISC) and the
# notices of the long ones.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided AS IS, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    ],
    "apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    ],
}

SCHEMA = "doc_id long, key long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, hits array<struct<pos:int,gram:long>>"


def _templates(templates: dict[str, list[str]], k: int) -> tuple[list[tuple], np.ndarray]:
    """Rows (template, label, size in grams, gram, position) of all templates, and their gram hashes."""
    rows, n = [], 0
    for label, texts in sorted(templates.items()):
        words = Words(pa.array(texts, pa.string()), WORDY)
        at, grams = words.grams(k)
        owner = words.text_of_word()[at] if len(at) else at
        for t in range(len(texts)):
            mine = np.flatnonzero(owner == t)
            rows += [(n + t, label, len(mine), int(g), int(p)) for g, p in zip(grams[mine].view(np.int64), at[mine] - words.first[t], strict=True)]
        n += len(texts)
    return rows, np.array([r[3] for r in rows], np.int64).view(np.uint64)


def _scan(batches: Iterator[pa.RecordBatch], grams: np.ndarray, k: int, phrases: dict[str, str]) -> Iterator[pa.RecordBatch]:
    lookup = Lookup(grams)
    parts = [(np.array([word_hash(w) for w in p.split()], np.uint64), label) for p, label in phrases.items()]
    whole = [(len(p), int(run_hashes(p, np.array([0]), np.array([len(p)]))[0]), label) for p, label in parts]
    for batch in chunks(batches):
        words = Words(batch.column("text"), WORDY)
        n, doc_of = len(words), words.text_of_word()
        count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
        labels: list[set] = [set() for _ in range(n)]
        for (p, _), (size, h, label) in zip(parts, whole, strict=True):
            start = np.flatnonzero(words.hash == p[0])
            room = words.first[1:][doc_of[start]] - start
            start = start[room >= size]
            start = start[run_hashes(words.hash, start, start + size) == np.uint64(h)]
            np.add.at(count, doc_of[start], 1)
            np.minimum.at(first, doc_of[start], start - words.first[doc_of[start]])
            np.maximum.at(last, doc_of[start], start - words.first[doc_of[start]])
            for d in np.unique(doc_of[start]).tolist():
                labels[d].add(label)
        at, g = words.grams(k)
        hit, _ = lookup.find(g)
        at, g = at[hit], g[hit].view(np.int64)
        cut = np.searchsorted(at, words.first).astype(np.int32)
        hits = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([pa.array((at - words.first[doc_of[at]]).astype(np.int32)), pa.array(g)], ["pos", "gram"]))
        nothing = count == 0
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("key"), pa.array(np.diff(words.first)), pa.array(count),
                pa.array(first, mask=nothing), pa.array(last, mask=nothing), pa.array([sorted(x) for x in labels], pa.list_(pa.string())), hits,
            ], ["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base_labels", "hits"],
        )


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = 5, slack: int = 3, least: float = 0.6) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and found
    (array of {label, first_word, end_word, cover}).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased.  Base: places where a phrase's
    words stand in a row.  Method: every k-gram of the document that a template holds votes for the diagonal (document
    position minus template position); diagonals at most `slack` apart are merged, as a few words more or less shift
    the rest of a passage.  A merged diagonal is verified if its k-grams cover at least `least` of the template's words and
    it spans at most twice as many.  score: 1 with a base phrase, else the best cover.  A null text is empty;
    texts without words have no labels and score 0; repeated rows give repeated results.

    Documents are scanned once, into a table of counts and hits; only hits are joined and grouped, by document and
    template, so no document or template common to many meets in one task.  The templates are constants of this module
    or an argument of that kind, and are broadcast.
    """
    spark = docs.sparkSession
    rows, grams = _templates(templates, k)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    scanned = written(source.mapInArrow(lambda b: _scan(b, grams, k, phrases), SCHEMA), "licenses")
    places = spark.createDataFrame(rows, "template int, label string, grams int, gram long, place int")
    votes = (
        scanned.where(F.size("hits") > 0).dropDuplicates(["key"]).select("key", F.explode("hits").alias("h")).select("key", "h.pos", "h.gram")
        .join(F.broadcast(places), "gram")
        .groupBy("key", "template", "label", "grams", (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    )
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    runs = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > slack).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(by))
    passages = (
        runs.groupBy("key", "template", "label", "grams", "run")
        .agg(F.flatten(F.collect_list("places")).alias("places"), F.min("lo").alias("lo"), (F.max("hi") + k).alias("hi"))
        .withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + k - 1))))))
        .withColumn("cover", F.col("covered") / (F.col("grams") + k - 1))
        .withColumn("good", (F.col("cover") >= least) & (F.col("hi") - F.col("lo") <= 2 * (F.col("grams") + k - 1)))
    )
    judged = passages.groupBy("key").agg(
        F.collect_list(F.when(F.col("good"), F.struct("label", F.col("lo").cast("long").alias("first_word"), F.col("hi").cast("long").alias("end_word"), "cover"))).alias("found"), F.max("cover").alias("best")
    )
    none = F.array().cast("array<struct<label:string,first_word:bigint,end_word:bigint,cover:double>>")
    out = scanned.drop("hits").join(judged, "key", "left").withColumn("found", F.array_sort(F.coalesce("found", none)))
    names = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("found", lambda f: f["label"]))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(names, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "found",
    )
