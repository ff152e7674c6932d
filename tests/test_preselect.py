"""The summary pre-selection and bucket caps against greedy loops over plain rows."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tidewell.config import Settings
from tidewell.operators import selection
from tidewell.plans import catalogue
from tidewell.sources import adapters


def plain_limits(items, surfaces, settings):
    recent = [r for r in items if r["hours_old"] <= settings.window_hours]
    by_lang, by_surface = defaultdict(list), defaultdict(Counter)
    for r in recent:
        if r["lang_group"] is not None:
            by_surface[r["surface_key"]][r["lang_group"]] += 1
            if r["hotness"] is not None:
                by_lang[r["lang_group"]].append(r["hotness"])
    cutoff, pool = {}, {}
    for lang, scores in by_lang.items():
        percent = settings.hot_percent_by_locale.get(lang, settings.hot_percent)
        cutoff[lang] = sorted(scores, reverse=True)[max(1, int(len(scores) * percent / 100)) - 1]
        pool[lang] = sum(s >= cutoff[lang] for s in scores)
    limits = {}
    for s in surfaces:
        langs = by_surface[s["surface_key"]]
        if not s["enabled"] or not (s["floor_percent"] > 0 or s["cap_percent"] is not None) or not langs:
            continue
        lang = min(langs, key=lambda x: (-langs[x], x))
        if pool.get(lang):
            floor = max(1, int(pool[lang] * s["floor_percent"] / 100)) if s["floor_percent"] > 0 else 0
            limits[s["surface_key"]] = (floor, None if s["cap_percent"] is None else int(pool[lang] * s["cap_percent"] / 100))
    return limits, cutoff


def plain_preselect(items, surfaces, settings, langs, limit, extra):
    limits, cutoff = plain_limits(items, surfaces, settings)
    pending = [r for r in items if r["hotness"] is not None and r["summary_status"] == "pending"]
    taken, per_surface = [], Counter()
    for s in sorted((s for s in surfaces if limits.get(s["surface_key"], (0,))[0] and s["floor_percent"] > 0), key=lambda s: (-s["floor_percent"], s["region_id"], s["surface_key"])):
        floor, cap = limits[s["surface_key"]]
        own = [r for r in pending if r["surface_key"] == s["surface_key"]]
        own.sort(key=lambda r: ((-r["published_at"].timestamp() if s["surface_type"] == "rss_feed" else -r["hotness"]), r["id"]))
        want = min(floor, floor if cap is None else cap, limit - len(taken))
        for r in own[: max(0, want)]:
            taken.append(r["id"])
            per_surface[s["surface_key"]] += 1
    for lang in sorted(langs):
        if len(taken) >= limit or lang not in cutoff or (settings.source_langs and lang not in settings.source_langs):
            continue
        held = set(taken)
        own = [r for r in pending if r["lang_group"] == lang and r["hotness"] >= cutoff[lang] and r["id"] not in held]
        own.sort(key=lambda r: (-r["hotness"], r["id"]))
        for r in own[: limit - len(taken) + extra]:
            cap = limits.get(r["surface_key"], (0, None))[1]
            if len(taken) >= limit:
                break
            if cap is not None and per_surface[r["surface_key"]] >= cap:
                continue
            taken.append(r["id"])
            per_surface[r["surface_key"]] += 1
    return sorted(taken)


@pytest.mark.parametrize(("limit", "extra"), [(60, 10), (500, 50), (9, 0)])
def test_preselect_equals_the_greedy_loop(spark, sf, limit, extra):
    items, surfaces, langs = adapters.scored_items(spark, sf), adapters.surfaces(spark), ["en", "fr", "de", "es"]
    settings = Settings()
    rows, places = [r.asDict() for r in items.collect()], [r.asDict() for r in surfaces.collect()]
    got = sorted(r.id for r in selection.summary_preselect(items, surfaces, settings, langs, limit, extra).collect())
    assert got == plain_preselect(rows, places, settings, langs, limit, extra) and got


def test_registered_preselect(spark, sf):
    rows, places = [r.asDict() for r in adapters.scored_items(spark, sf).collect()], [r.asDict() for r in adapters.surfaces(spark).collect()]
    got = sorted(r.id for r in catalogue.summary_preselect(spark, sf).collect())
    assert got == plain_preselect(rows, places, catalogue.SETTINGS, ["en", "fr", "de", "es"], 60, 10)


@pytest.mark.parametrize("percent", [1.0, 10.0, 40.0, 100.0])
def test_bucket_cap(spark, percent):
    r = random.Random(int(percent))
    rows = [(i, r.choice(["hot"] * 5 + ["a", "b", None]), r.choice([None, 1.0, 2.0, float(i % 7), r.random()])) for i in range(500)]
    got = {x.id for x in selection.bucket_cap(spark.createDataFrame(rows, "id long, bucket string, hotness double"), percent).collect()}
    want = set()
    for b in {x[1] for x in rows}:
        own = sorted((x for x in rows if x[1] == b), key=lambda x: (x[2] is None, -(x[2] or 0.0), x[0]))
        want |= {x[0] for x in own[: math.floor(len(rows) * percent / 100)]}
    assert got == want
