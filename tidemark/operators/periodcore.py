"""Numpy core of the period algebra: whole lists of periods, key by key, worked through a batch at a time.

Days are numbers since 1970. A batch holds the periods of many keys; ``k`` says which key a period belongs to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

NONE = -(1 << 30)
_BITS, _OFF = 23, 1 << 22


def _days(a: pa.Array) -> np.ndarray:
    return a.cast(pa.date32()).cast(pa.int32()).fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The row of every item of the lists, and the items; a null list has none."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.value_parent_indices().to_numpy().astype(np.int64), lists.flatten()


def _at(k: np.ndarray, day: np.ndarray) -> np.ndarray:
    return (k << _BITS) + day + _OFF


def periods_of(lists: pa.Array) -> dict[str, np.ndarray]:
    """Tiles by key: k, start, end, val, ok (has a value), filed, n, derived."""
    k, items = _flat(lists)
    val = items.field("val")
    return {
        "k": k, "start": _days(items.field("start")), "end": _days(items.field("end")), "val": val.fill_null(0.0).to_numpy(zero_copy_only=False), "ok": val.is_valid().to_numpy(zero_copy_only=False),
        "filed": _days(items.field("filed")), "n": items.field("n").to_numpy(zero_copy_only=False).astype(np.int64), "derived": items.field("derived").to_numpy(zero_copy_only=False).astype(bool),
    }


def _pairs(group: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items sorted by group, every one with each of those before it in its group."""
    g = group[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(g) else np.zeros(0, np.int64)
    n = np.arange(len(g)) - head
    a = np.repeat(np.arange(len(g)), n)
    b = head[a] + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    return order[a], order[b]


def _fresh(x: dict[str, np.ndarray], rows: int) -> dict[str, np.ndarray] | None:
    """Periods that are left when one is taken from a longer one and that are not known yet, the first of each."""
    live = np.flatnonzero(x["live"])
    if not len(live):
        return None
    k, s, e, n = (x[c][live] for c in ("k", "start", "end", "n"))
    # sharing a start, the shorter ends earlier; sharing an end, it starts later
    long_t, short_t = _pairs(_at(k, s), np.lexsort((e, s, k)))
    long_h, short_h = _pairs(_at(k, e), np.lexsort((-s, e, k)))
    b, c = np.concatenate([long_t, long_h]), np.concatenate([short_t, short_h])
    start = np.concatenate([e[short_t] + 1, s[long_h]])
    end = np.concatenate([e[long_t], s[short_h] - 1])
    code = _at(_at(k[b], start), end)
    known = np.sort(_at(_at(k, s), e))
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    new = np.flatnonzero(known[at] != code)
    if not len(new):
        return None
    order = new[np.lexsort((n[c[new]], n[b[new]], code[new]))]
    first = np.ones(len(order), bool)
    first[1:] = code[order][1:] != code[order][:-1]
    pick = order[first]
    pick = pick[np.lexsort((n[c[pick]], n[b[pick]], k[b[pick]]))]
    kk = k[b[pick]]
    before = np.zeros(rows, np.int64)
    np.maximum.at(before, x["k"], x["n"])
    place = np.arange(len(kk)) - np.searchsorted(kk, kk) + 1
    bi, ci = live[b[pick]], live[c[pick]]
    out = {"k": kk, "start": start[pick], "end": end[pick], "val": x["val"][bi] - x["val"][ci], "ok": x["ok"][bi] & x["ok"][ci], "filed": np.maximum(x["filed"][bi], x["filed"][ci]), "n": before[kk] + place}
    return out | {"form": x["form"][bi], "derived": np.ones(len(kk), bool), "live": np.ones(len(kk), bool), "b0": x["start"][bi], "b1": x["end"][bi], "s0": x["start"][ci], "s1": x["end"][ci]}


def closed(lists: pa.Array, whole: pa.Array, passes: int) -> dict:
    """The known periods of every row after so many passes, by row and number; rows that aren't ``whole`` derive nothing."""
    k, items = _flat(lists)
    val, size = items.field("val"), len(k)
    ok = whole.to_numpy(zero_copy_only=False).astype(bool)
    start, end = _days(items.field("start")), _days(items.field("end"))
    blank = np.full(size, NONE, np.int64)
    x = {
        "k": k, "start": start, "end": end, "val": val.fill_null(0.0).to_numpy(zero_copy_only=False), "ok": val.is_valid().to_numpy(zero_copy_only=False), "filed": _days(items.field("filed")),
        "n": np.arange(size) - np.searchsorted(k, k) + 1, "form": np.arange(size), "derived": np.zeros(size, bool), "live": ok[k] & (end != NONE), "b0": blank, "b1": blank, "s0": blank, "s1": blank,
    }
    for _ in range(passes):
        more = _fresh(x, len(lists))
        if more is None:
            break
        x = {c: np.concatenate([x[c], more[c]]) for c in x}
    order = np.lexsort((x["n"], x["k"]))
    return {c: v[order] for c, v in x.items()} | {"forms": items.field("form"), "rows": len(lists)}


def _dates(x: np.ndarray) -> pa.Array:
    return pa.array(np.where(x == NONE, 0, x).astype(np.int32), pa.int32(), mask=x == NONE).cast(pa.date32())


def _lists(rows: int, k: np.ndarray, columns: list[pa.Array], names: list[str]) -> pa.Array:
    offsets = np.searchsorted(k, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names))


def to_lists(x: dict) -> pa.Array:
    columns = [_dates(x["start"]), _dates(x["end"]), pa.array(x["val"], mask=~x["ok"]), x["forms"].take(pa.array(x["form"])), _dates(x["filed"]), pa.array(x["n"].astype(np.int32))]
    return _lists(x["rows"], x["k"], [*columns, *[_dates(x[c]) for c in ("b0", "b1", "s0", "s1")]], ["start", "end", "val", "form", "filed", "n", "b_start", "b_end", "s_start", "s_end"])


def _walk(x: dict, k: np.ndarray, begin: np.ndarray, to: np.ndarray, first_slack: int, slack: int, most: int) -> dict[str, np.ndarray]:
    """The first cover of every window: found, tiles, value, ok, days, derived, filed.

    States of a window stand in the order of their paths. Those behind a cover can't come first any more, and of
    two that have come equally far with as many tiles the first one decides.
    """
    use = np.flatnonzero((x["start"] != NONE) & (x["end"] != NONE))
    use = use[np.lexsort((x["n"][use], x["start"][use] - x["end"][use], x["start"][use], x["k"][use]))]
    s, e, v, fine, filed, derived = (x[c][use] for c in ("start", "end", "val", "ok", "filed", "derived"))
    code = _at(x["k"][use], s)
    w = np.flatnonzero((begin != NONE) & (to != NONE))
    f = {"w": w, "at": begin[w], "tiles": np.zeros(len(w), np.int64), "value": np.zeros(len(w)), "ok": np.ones(len(w), bool), "days": np.zeros(len(w), np.int64), "derived": np.zeros(len(w), bool), "filed": np.full(len(w), NONE, np.int64)}
    for depth in range(most):
        w, at = f["w"], f["at"]
        whole = np.abs(at - to[w]) <= 1
        if whole.all():
            break
        near = first_slack if depth == 0 else slack
        a = np.searchsorted(code, _at(k[w], at - near))
        b = np.searchsorted(code, _at(k[w], at + near), side="right")
        n = np.where(whole, 1, np.where(at <= to[w], b - a, 0))
        src = np.repeat(np.arange(len(w)), n)
        t = a[src] + np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
        stay = whole[src]
        t[stay] = 0
        good = stay.copy()
        move = np.flatnonzero(~stay)
        good[move] = e[t[move]] <= to[w[src[move]]] + first_slack
        src, t, stay = src[good], t[good], stay[good]
        f = {c: y[src] for c, y in f.items()}
        m = np.flatnonzero(~stay)
        tm = t[m]
        f["at"][m] = e[tm] + 1
        f["tiles"][m] += 1
        f["value"][m] += v[tm]
        f["ok"][m] &= fine[tm]
        f["days"][m] += e[tm] - s[tm] + 1
        f["derived"][m] |= derived[tm]
        f["filed"][m] = np.maximum(f["filed"][m], filed[tm])
        done = np.abs(f["at"] - to[f["w"]]) <= 1
        # behind the first cover of its window, or after another at the same day
        count = np.cumsum(done) - done
        heads = np.searchsorted(f["w"], f["w"])
        behind = count - count[heads] > 0 if len(count) else np.zeros(0, bool)
        mark = f["w"] * (1 << _BITS) + f["at"] + _OFF
        only = np.zeros(len(mark), bool)
        only[np.unique(mark, return_index=True)[1]] = True
        keep = ~behind & (only | done)
        f = {c: y[keep] for c, y in f.items()}
    done = np.flatnonzero(np.abs(f["at"] - to[f["w"]]) <= 1)
    firsts, where = np.unique(f["w"][done], return_index=True)
    pick = done[where]
    out = {"found": np.zeros(len(k), bool)} | {c: np.zeros(len(k), f[c].dtype) for c in ("tiles", "value", "ok", "days", "derived", "filed")}
    out["found"][firsts] = True
    for c in ("tiles", "value", "ok", "days", "derived", "filed"):
        out[c][firsts] = f[c][pick]
    return out


def _answers(rows: int, k: np.ndarray, r: dict[str, np.ndarray]) -> pa.Array:
    no = ~r["found"]
    filed = _dates(np.where(no, NONE, r["filed"]))
    columns = [pa.array(r["tiles"].astype(np.int32), mask=no), pa.array(r["value"], mask=no | ~r["ok"]), pa.array(r["days"].astype(np.int32), mask=no), pa.array(r["derived"], mask=no), filed]
    return _lists(rows, k, columns, ["tiles", "value", "days", "derived", "filed"])


def _windows(ends: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, items = _flat(ends)
    return k, _days(items.field("from")), _days(items.field("to"))


def covers(x: dict, ends: pa.Array, first_slack: int, slack: int, most: int) -> pa.Array:
    k, begin, to = _windows(ends)
    return _answers(len(ends), k, _walk(x, k, begin, to, first_slack, slack, most))


def trailing(x: dict, ends: pa.Array, annual: tuple[int, int], first_slack: int, slack: int, most: int) -> pa.Array:
    """Covers of the windows; tiles of -1 say that one filed year ends with the window, of those the one that begins first."""
    k, begin, to = _windows(ends)
    length = x["end"] - x["start"] + 1
    year = np.flatnonzero(~x["derived"] & x["live"] & (length >= annual[0]) & (length <= annual[1]))
    year = year[np.lexsort((x["start"][year], x["end"][year], x["k"][year]))]
    code, asked = _at(x["k"][year], x["end"][year]), _at(k, np.where(to == NONE, 0, to))
    at = np.searchsorted(code, asked)
    hit = (to != NONE) & (at < len(code))
    hit[hit] = code[at[hit]] == asked[hit]
    r = _walk(x, k, np.where(hit, NONE, begin), to, first_slack, slack, most)
    one = year[at[hit]]
    r["found"][hit], r["tiles"][hit], r["derived"][hit] = True, -1, False
    for c, y in (("value", x["val"]), ("ok", x["ok"]), ("days", length), ("filed", x["filed"])):
        r[c][hit] = y[one]
    return _answers(len(ends), k, r)
