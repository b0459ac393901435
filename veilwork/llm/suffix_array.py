"""Suffix arrays of many strings at once, by the linear grouping construction.

Phase 1 sorts suffixes into groups that share their Lyndon prefix. It starts from groups by first
symbol and takes groups in descending order: for each suffix of the group the previous suffix in a
lower group is found by following previous-smaller pointers; these previous suffixes, gathered by
their own group and by how many of the group point to them, are moved into new groups right behind
their old ones (their Lyndon prefix grows by that many copies of the group's). Phase 2 takes groups
in ascending order and emits each one's order from the ranks of what follows its Lyndon prefix,
which lie in lower groups and are final; nothing is renamed. Wherever suffixes are put in order by
such numbers, they are counted in 16-bit digits, so each step is linear.

All strings advance in step, one group each at a time, so every step is a few array operations.
"""

from __future__ import annotations

import numpy as np


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + size[0] - 1, first[1] .. and so on."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def _order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by the last key, then the one before it and so on, in linear time: by counting 16 bits at once."""
    order = None
    for key in keys:
        top = int(key.max()) if len(key) else 0
        for shift in range(0, max(1, top.bit_length()), 16):
            digit = ((key >> shift) & 0xFFFF).astype(np.uint16)
            if order is None:
                order = np.argsort(digit, kind="stable")
            else:
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _lyndon_groups(text: np.ndarray, offsets: np.ndarray):
    """(slots, label, ends, size): suffixes by group, the group's first slot for each suffix, each
    group's end by its first slot, and the length of each suffix's Lyndon prefix."""
    n, lengths = len(text), np.diff(offsets)
    string = np.repeat(np.arange(len(lengths)), lengths)
    slots = _order(text, string)
    new = np.ones(n, bool)
    new[1:] = (text[slots[1:]] != text[slots[:-1]]) | (string[slots[1:]] != string[slots[:-1]])
    starts = np.flatnonzero(new)
    ends = np.zeros(n + 1, np.int64)
    ends[starts] = np.append(starts[1:], n)
    label = np.empty(n, np.int64)
    label[slots] = np.repeat(starts, np.diff(np.append(starts, n)))
    place = np.empty(n, np.int64)
    place[slots] = np.arange(n)
    size, before, low = np.ones(n, np.int64), np.arange(n) - 1, offsets[string]
    todo = offsets[1:].copy()  # groups from here on are done
    active = np.flatnonzero(todo > offsets[:-1])
    while len(active):
        end = todo[active]
        start = label[slots[end - 1]]
        todo[active] = start
        active = active[start > offsets[active]]
        members = slots[_ranges(start, end - start)]
        group = np.repeat(start, end - start)
        floor, wait = low[members], np.arange(len(members))
        while True:
            to = before[members[wait]]
            higher = (to >= floor[wait]) & (label[np.maximum(to, 0)] >= group[wait])
            wait = wait[higher]
            if not len(wait):
                break
            before[members[wait]] = before[to[higher]]
        to = before[members]
        has = to >= floor
        if not has.any():
            continue
        to, grown = to[has], size[members[has]]
        if len(to) > 1:
            order = _order(to)
            to, grown = to[order], grown[order]
            first = np.ones(len(to), bool)
            first[1:] = to[1:] != to[:-1]
            at = np.flatnonzero(first)
            moved, count = to[at], np.diff(np.append(at, len(to)))
            size[moved] += count * grown[at]
            order = _order(count, label[moved])
            moved, count = moved[order], count[order]
        else:
            moved, count = to, np.ones(1, np.int64)
            size[moved] += grown
        old = label[moved]
        first = np.ones(len(moved), bool)
        first[1:] = old[1:] != old[:-1]
        at = np.flatnonzero(first)
        n_moved = np.diff(np.append(at, len(moved)))
        q, q_end = old[at], ends[old[at]]
        goal_first = q_end - n_moved
        goal = _ranges(goal_first, n_moved)
        # who stands in the goal slots without being moved changes places with the moved ones outside
        mark = slots[goal]
        outside = place[moved] < np.repeat(goal_first, n_moved)
        is_moved = np.zeros(len(goal), bool)
        inside = place[moved[~outside]]
        if len(inside):
            is_moved[np.searchsorted(goal, inside)] = True
        stay, hole = mark[~is_moved], place[moved[outside]]
        slots[hole] = stay
        place[stay] = hole
        slots[goal] = moved
        place[moved] = goal
        ends[q] = goal_first
        cut = first.copy()
        cut[1:] |= count[1:] != count[:-1]
        piece = np.flatnonzero(cut)
        piece_size = np.diff(np.append(piece, len(moved)))
        piece_start = goal[piece]
        label[moved] = np.repeat(piece_start, piece_size)
        ends[piece_start] = piece_start + piece_size
    return slots, label, ends, size


def suffix_arrays(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Suffixes (places in ``text``) in order, string by string.

    Each string ends with a symbol that is smaller than all others and occurs once in it.
    """
    slots, label, ends, size = _lyndon_groups(text, offsets)
    n = len(text)
    starts = np.unique(label)
    many = starts[ends[starts] - starts > 1]
    rank = np.empty(n, np.int64)
    rank[slots] = np.arange(n)
    string = np.searchsorted(offsets, many, side="right") - 1
    turn = np.arange(len(many)) - np.searchsorted(string, string)
    for k in range(int(turn.max()) + 1 if len(turn) else 0):
        first = many[turn == k]
        width = ends[first] - first
        at = _ranges(first, width)
        members, group = slots[at], np.repeat(first, width)
        follows, copies = members + size[members], np.ones(len(members), np.int64)
        again = np.flatnonzero(label[np.minimum(follows, n - 1)] == group)
        while len(again):
            copies[again] += 1
            follows[again] += size[follows[again]]
            again = again[label[np.minimum(follows[again], n - 1)] == group[again]]
        order = _order(rank[np.minimum(follows, n - 1)], copies, group)
        slots[at] = members[order]
        rank[members[order]] = at
    return slots
