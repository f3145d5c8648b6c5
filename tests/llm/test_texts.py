"""Quality, decontamination, toxicity, licences, personal data and URLs against brute force."""

import hashlib
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrob.llm import decontaminate, disclosure, licenses, quality, toxicity, url_templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clash(df):
    return df.withColumns({c: F.lit("x") for c in ("n_words", "kept", "size", "spans", "score", "host", "carried", "item_id")})


# --- quality -----------------------------------------------------------------


def counted(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_equal_a_loop(rows_of):
    rng = random.Random(5)
    texts = [None, "", " ", "a", "a b", "a b c a b c", "x " * 3000, "é\x0b#\u00a0*\n\n é\x0b#\u00a0*", "w" * 100_000]
    texts += ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "\t", "$", "|", "ü"]) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    rows = [(i, t, rng.choice(["en", None])) for i, t in enumerate(texts)] + [(None, "a b", None), (3, "a", "en")]
    got = quality.judge(clash(rows_of(rows, "doc_id bigint, text string, lang string"))).collect()
    assert len(got) == len(rows)
    want = Counter((i, *counted(t)) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_prose_and_drops_noise(rows_of):
    rng = random.Random(6)
    vocabulary = ["the", "of", "and", "to", "river", "market", "question", "winter", "garden", "letter", "stone", "reader"]
    prose = [(i, " ".join(rng.choice(vocabulary) for _ in range(120)) + ".", "en") for i in range(80)]
    noise = [(100 + i, " ".join(rng.choice(vocabulary).upper() + "***" for _ in range(120)), "en") for i in range(8)]
    df = rows_of(prose + noise, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in quality.keep_good(df).collect()}
    assert kept == {i for i, *_ in prose}
    assert quality.keep_good(clash(df)).columns == clash(df).columns


def test_documents_stay_in_place_and_a_rare_language_is_drawn_to_the_average(rows_of):
    rng = random.Random(2)
    words = "the of and to house river long road town mill farm sea summer old big stone gate hill walked seen".split()
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "s", "ly"]) for _ in range(120)), "en") for i in range(40)]
    df = rows_of(rows + [(99, " ".join(f"#{i * 7919}%$|" for i in range(120)), "xx")], "doc_id bigint, text string, lang string")
    plan = quality.keep_good(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lang" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert all(kept[i] for i in range(40)) and not kept[99]  # alone in its language, yet not its own measure


def test_quality_of_nothing(rows_of):
    assert quality.judge(rows_of([], "doc_id bigint, text string, lang string")).collect() == []


# --- decontamination ----------------------------------------------------------

ITEMS = [(1, "Which river crosses the old harbour town? The silver brook does."), (2, "alpha beta gamma delta epsilon zeta eta theta iota"),
         (3, None), (4, ""), (2, "Étrange maison près du grand pont rouge. Oui madame.")]
FILLER = "and so the story of the town went on for many years without any change at all "


def test_leaks_are_found_and_clean_texts_left(rows_of):
    rows = [(0, FILLER * 3), (1, FILLER * 40 + ITEMS[0][1] + FILLER * 5), (2, ITEMS[1][1].upper()), (3, None), (4, ""), (5, FILLER + ITEMS[4][1].upper()),
            (6, "river harbour town silver"), (6, ITEMS[1][1]), (None, ITEMS[1][1]), (7, "Which river crosses the old harbour?")]
    benchmark = rows_of(ITEMS, "item_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"]) for r in decontaminate.contaminated(clash(rows_of(rows)), benchmark).collect())
    assert got == [(-1, 2), (1, 1), (2, 2), (5, 2), (6, 2)]
    left = decontaminate.clean(rows_of(rows), benchmark).collect()
    assert sorted(r["doc_id"] for r in left) == [0, 3, 4, 6, 7]
    none = rows_of([], "item_id bigint, text string")
    assert decontaminate.contaminated(rows_of(rows), none).collect() == []
    assert decontaminate.contaminated(rows_of([]), benchmark).collect() == []


def test_retrieval_equals_scoring_every_item():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 12)))) for i in range(300)]
    index = decontaminate.Index(items)
    for tuned in (False, True):
        if tuned:
            index.tune(np.array([rng.randint(0, 1000) for _ in index.words]))
        hits = [(rng.randrange(len(index.words)), p) for p in range(200) for _ in range(rng.randint(1, 25))]
        rng.shuffle(hits)
        got = {(p, i): s for p, i, s in index.retrieve(*map(np.array, zip(*hits)))}
        want = Counter()
        for word, p in set(hits):
            for at in np.flatnonzero(index.word == word):
                want[(p, int(index.item[at]))] += index.weight[at]
        assert {k for k, s in want.items() if s >= decontaminate.THRESHOLD + 1e-9} <= set(got)
        assert all(abs(want[k] - s) < 1e-9 and s >= decontaminate.THRESHOLD for k, s in got.items())


# --- toxicity -----------------------------------------------------------------


def test_toxicity_on_held_out_rows(rows_of):
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in ("lor", "mip", "tas", "ven", "qui") for b in ("an", "el", "os", "ur", "im")]
    bad = ["gromble", "vexnak"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        body = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        for _ in range(3 * toxic):
            body.insert(rng.randrange(len(body)), rng.choice(bad + ["gr0mble", "v3xnak", "VEXNAK"]))
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    rows += [(10_000, None), (10_001, ""), (None, "gromble vexnak gromble")]
    got = toxicity.score(clash(rows_of(rows)), rows_of(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    truth = dict(labels)
    assert all(r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth)
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert next(r for r in got if r["doc_id"] is None)["predicted"] == 1
    unlabelled = toxicity.score(rows_of(rows[:5]), rows_of([], "doc_id bigint, toxic int")).collect()
    assert {r["score"] for r in unlabelled} == {0.0}


def test_scores_keep_their_meaning_when_the_sample_is_full(rows_of, monkeypatch):
    rng = random.Random(12)
    plain = [f"{a}{b}" for a in ("lor", "mip", "tas", "ven", "qui") for b in ("an", "el", "os", "ur", "im")]
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 9 == 0
        body = [rng.choice(plain) for _ in range(30)]
        if rng.random() < (0.7 if toxic else 0.1):
            body[rng.randrange(30)] = "gromble"
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    docs, known = rows_of(rows), rows_of(labels, "doc_id bigint, toxic int")

    def mean():
        return toxicity.score(docs, known).agg(F.avg("score")).first()[0]

    assert abs(mean() - 1 / 9) < 0.02
    for size in (150, 600):  # both classes cut, then only the larger one
        monkeypatch.setattr(toxicity, "SAMPLE", size)
        assert abs(mean() - 1 / 9) < 0.03


def test_folding_and_exceptions():
    scanner = toxicity.Scanner({toxicity.fold("idiot").strip(): 2.0}, [toxicity.fold("idiot board").strip()])
    for text in ("idiot", "1d10t!", "IDIOT,", "ｉｄｉｏｔ", "і\u200bdiot", "(idiots)"):
        assert scanner.hits(toxicity.fold(text)), text
    for text in ("", "noidiot", "the idiot board"):
        assert not scanner.hits(toxicity.fold(text)), text


# --- licences -----------------------------------------------------------------


def test_licences(rows_of):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
           "files (the \"Software\"), to deal in the Software without restriction.\n\nThe above copyright notice and this permission notice "
           "shall be included in all copies or substantial portions of the Software.\n\n{}THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND")
    rows = [(0, "text\nReleased under the MIT License."), (1, mit.format("")), (2, mit.format("more. " * 20)), (3, None), (4, ""),
            (5, "Copyright (c) 2019 Some One\nAll rights reserved."), (6, "a licence to print money"), (0, "text\nReleased under the MIT License."),
            (None, "x.\nLICENSED UNDER CC BY-NC 4.0.!!"), (7, "license " * 50_000)]
    got = Counter((r["doc_id"], r["license"], r["rule"]) for r in licenses.scan(clash(rows_of(rows))).collect())
    assert got == Counter({(0, "MIT", "mit-notice"): 2, (1, "MIT", "mit-grant>mit-condition>as-is"): 1, (2, "MIT", "mit-grant>mit-condition"): 1,
                           (5, "Proprietary", "copyright>all-rights"): 1, (None, "CC-BY-NC-4.0", "cc-by-nc-4.0-notice"): 1})
    spans = {r["doc_id"]: (r["start"], r["end"]) for r in licenses.scan(rows_of(rows[:1])).collect()}
    assert rows[0][1][slice(*spans[0])] == "Released under the MIT License"


PUBLISHED = {
    "MIT": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "Apache-2.0": """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "BSD-3-Clause": """Copyright (c) 2020, Some Body Inc.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

(2) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

 * Neither the name of Some Body Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""}


def test_published_licences_in_wrapped_lines(rows_of):
    rows, want = [], {}
    for name, text in PUBLISHED.items():
        for sign in ("", "# ", " * ", "// "):
            want[len(rows)] = name
            rows.append((len(rows), "code before\n" + "".join(f"{sign}{line}\n" for line in text.split("\n")) + "code after"))
        for width in (30, 45, 60, 73, 79, 100):
            want[len(rows)] = name
            rows.append((len(rows), "\n\n".join(textwrap.fill(" ".join(part.split()), width) for part in text.split("\n\n"))))
    rows += [(100, "All rights\nreserved."), (101, "All rights\n\nreserved."), (102, "All rights. Reserved")]
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(rows_of(rows)).collect())
    assert got == [*want.items(), (100, "Proprietary")]
    longest = {r["doc_id"]: r["rule"].count(">") for r in licenses.scan(rows_of(rows)).collect()}
    assert [longest[i] for i in range(0, 40, 10)] == [2, 2, 3, 1]


# --- personal data ------------------------------------------------------------

KINDS = ["email", "ip", "card", "phone"]


def luhn(digits):
    worth = [int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(digits))]
    return sum(worth) % 10 == 0


def found(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (12 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else 9 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_matching(rows_of):
    rng = random.Random(1)
    parts = ["a@b.c", "x.y@z-1.co.uk", "_@q.w@e.r", "1.2.3.4", "1.2.3.4.5.6.7.8", "255.1.1.256", "0001.2.3.4", "4111 1111 1111 1111",
             "5500000000000004", "12", "3 4-5", "+1 (415) 555-0100", "+12+3456789012", "é", "\U0001F600", " ", ".", "-", "+", "@", "%"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(900, "1" * 50_000), (901, "1 " * 30_000), (902, "x@" + "a." * 20_000 + "b"), (903, "+1" + "-" * 30_000), (904, None), (None, "a@b.c"),
             (0, rows[0][1])]
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])
                  for r in disclosure.listed(clash(rows_of(rows))).collect())

    def expected(i, text):
        spans = found(text or "")
        listing = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        return (i, *[sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(listing.encode()).hexdigest())

    assert got == Counter(expected(i, t) for i, t in rows)


def test_terms_that_give_an_entity_away(rows_of):
    rows = [(i, f"notice {i} from the harbourmaster at sea@port.org about the weather") for i in range(4)]
    rows += [(10 + i, f"the weather was fine and the notice about number {i} from town") for i in range(30)]
    spans = {r["doc_id"]: r["spans"] for r in disclosure.listed(rows_of(rows)).collect()}
    for i in range(4):
        words = {rows[i][1][int(a):int(b)] for kind, a, b in (s.split(":") for s in spans[i].split(",")) if kind == "term"}
        assert words == {"harbourmaster"}
    assert all(spans[10 + i] == "" for i in range(30))
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(rows_of(rows)).collect()}
    assert clean[0] == "notice 0 from the  at [EMAIL] about the weather" and clean[12] == rows[6][1]


def test_terms_far_from_the_entity_and_without_it(rows_of):
    far = "the weather was fine and the notice was long, so nobody in town read it to the end. " * 3
    rows = [(i, f"notice {i} from sea@port.org. {far}Signed, Harbourmaster") for i in range(4)]
    rows += [(4, "the HARBOURMASTER was fine, harbourmasters were not"), (5, None), (None, "harbourmaster"), (4, "harbourmaster"), (6, "b" * 5000)]
    rows += [(10 + i, f"{far} number {i} signed from") for i in range(30)]
    got = Counter((r["doc_id"], r["n_term"]) for r in disclosure.listed(clash(rows_of(rows))).collect())
    assert got == Counter([*((i, 1) for i in range(4)), (4, 1), (4, 1), (None, 1), (5, 0), (6, 0), *((10 + i, 0) for i in range(30))])
    clean = Counter((r["doc_id"], r["text"]) for r in disclosure.sanitised(rows_of(rows)).collect())
    assert clean[(4, "the [TERM] was fine, harbourmasters were not")] == 1 and clean[(None, "[TERM]")] == 1
    assert clean[(0, f"notice 0 from [EMAIL]. {far}Signed, [TERM]")] == 1


# --- addresses ----------------------------------------------------------------


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in url_templates.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]))[0] if fits else None


def test_rules_and_parts_of_urls(rows_of):
    urls = ["http://a.net/", "http://a.net", "https://EXAMPLE.net/en/1?q#f", "http://notexample.com/de/x", "http://x.example.com/de/x", "ftp://net/a",
            "http://a.org/fr/1", "http://a.org/fr", "no scheme", None, "", "http://ÀB.net/x://y", "a://b?c/d", "://net/", "http://a.com/" + "x/" * 5000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[0])]
    df = rows_of(rows, "page_id bigint, url string", verdict=F.lit(1), rule=F.lit(2), segment=F.lit(3))
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in url_templates.judge(df).collect())
    assert got == Counter((i, *judged(u)) for i, u in rows)
    assert url_templates.judge(rows_of([], "page_id bigint, url string")).collect() == []


def test_templates_with_bad_labels_are_blocked(rows_of):
    rules = [("block", "shop.com", "/ads/x"), ("allow", "shop.com", "/help/")]
    rows = [(i, f"http://shop.com/ads/x{i}") for i in range(40)] + [(100 + i, f"http://shop.com/ads/y{i}") for i in range(5)]
    rows += [(200 + i, f"http://shop.com/help/{i}") for i in range(40)] + [(300, "http://shop.com/other"), (301, "http://else.com/ads/x1")]
    verdict = {r["page_id"]: r["verdict"] for r in url_templates.judge(rows_of(rows, "page_id bigint, url string"), rules).collect()}
    assert all(verdict[i] == "block" for i in [*range(40), *range(100, 105)])
    assert all(verdict[i] == "allow" for i in [*range(200, 240), 300, 301])
