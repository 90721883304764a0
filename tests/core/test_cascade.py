import random

import pytest

from medialedger import tables
from medialedger.identity import cascade

ITEMS = "id bigint, kind string, parent_id bigint, season_number int, title string"


def brute(items, ids, refs, plex=1):
    """Show after show, season after season, episode after episode."""
    items = {i: [kind, parent, number] for i, kind, parent, number, _ in items}
    idents = {}
    for i, p, x in ids:
        idents.setdefault(i, set()).add((p, x))
    held = {}
    for i, s in refs:
        held.setdefault(i, set()).add(s)
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and items[a][0] == items[b][0] == "show" and idents.get(a, set()) & idents.get(b, set()):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for i in items:
        if items[i][0] == "show":
            groups.setdefault(find(i), []).append(i)
    remap = {}

    def safe(members):
        sets = [held.get(i, set()) for i in members]
        return all(sets) and sum(map(len, sets)) == len(set().union(*sets))

    def fold(winner, loser):
        idents.setdefault(winner, set()).update(idents.pop(loser, set()))
        held.setdefault(winner, set()).update(held.pop(loser, set()))
        for row in items.values():
            if row[1] == loser:
                row[1] = winner
        del items[loser]
        remap[loser] = winner

    for members in groups.values():
        if len(members) < 2 or not safe(members):
            continue
        winner = min(members, key=lambda i: (plex not in held[i], i))
        for loser in sorted(set(members) - {winner}):
            for s in sorted(i for i, r in items.items() if r[0] == "season" and r[1] == loser):
                match = [i for i, r in items.items() if r[0] == "season" and r[1] == winner and r[2] == items[s][2]]
                if len(match) == 1:
                    for e in sorted(i for i, r in items.items() if r[0] == "episode" and r[1] == s):
                        found = [i for i, r in items.items() if r[1] == match[0] and idents.get(i, set()) & idents.get(e, set())]
                        if len(found) == 1 and safe([found[0], e]):
                            fold(found[0], e)
                        else:
                            items[e][1] = match[0]
                    fold(match[0], s)
                elif not match:
                    items[s][1] = winner
            fold(winner, loser)
    for i in remap:
        while remap[i] in remap:
            remap[i] = remap[remap[i]]
    return remap, {i: r[1] for i, r in items.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_cascade_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    items, ids, refs, n = [], [], [], 0
    for show in range(6):
        n += 1
        top = n
        items.append((top, "show", None, None, f"show {show}"))
        ids.append((top, "tvdb", f"s{show % 2 if show < 5 else 9}"))
        source = 1 + show // 2
        refs.append((top, source))
        for number in rng.sample([1, 1, 2, 3, None], 4):
            n += 1
            season = n
            items.append((season, "season", top, number, "season"))
            for _ in range(rng.randint(1, 4)):
                n += 1
                items.append((n, "episode", season, number, "episode"))
                ids += [(n, "tvdb", f"e{rng.randint(0, 5)}") for _ in range(rng.randint(0, 2))]
                refs += [(n, s) for s in {source, source if rng.random() < 0.8 else 1 + rng.randint(0, 2)} if rng.random() < 0.95]
    sources = spark.createDataFrame([(1, "jellyfin"), (2, "plex"), (3, "jellyfin")], "id int, connector_type string")
    frame = spark.createDataFrame(items, ITEMS)
    tables_ = spark.createDataFrame(ids, "media_item_id bigint, provider string, external_id string"), spark.createDataFrame(refs, "media_item_id bigint, source_id int")
    remap, moved = cascade.cascade(frame, *tables_, sources, tables.written, tables.discard)
    want, parents = brute(items, ids, refs, plex=2)
    assert {r["media_item_id"]: r["winner_id"] for r in remap.collect()} == want
    assert {r["id"]: r["parent_id"] for r in cascade.apply_cascade(frame, remap, moved).collect()} == parents
    assert any(i in want for i, kind, *_ in items if kind == "episode") and any(i in want for i, kind, *_ in items if kind == "season")


def test_nothing_to_merge(spark):
    frame = spark.createDataFrame([(1, "show", None, None, "a")], ITEMS)
    ids = spark.createDataFrame([], "media_item_id bigint, provider string, external_id string")
    refs = spark.createDataFrame([(1, 1)], "media_item_id bigint, source_id int")
    sources = spark.createDataFrame([(1, "plex")], "id int, connector_type string")
    remap, moved = cascade.cascade(frame, ids, refs, sources, tables.written, tables.discard)
    assert remap.isEmpty() and moved.isEmpty() and cascade.apply_cascade(frame, remap, moved).count() == 1
