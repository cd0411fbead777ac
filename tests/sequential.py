"""Factoring one object at a time, as a yardstick: enter children first, then the object; equal rows share an entry."""

from __future__ import annotations


class Sequential:
    """types: name -> list of (field, target or None, many); an object is (type, dict)."""

    def __init__(self, types, circular=(), two_phase=()):
        self.types, self.circular, self.two_phase = types, set(circular), set(two_phase)
        self.lists = {t: [] for t in types}
        self.keys = {t: {} for t in types}

    def enter(self, kind, obj):
        fields = self.types[kind]
        row = {f: obj[f] for f, target, _ in fields if target is None}
        links = [x for x in fields if x[1] is not None]
        early = [x for x in links if (kind, x[0]) not in self.circular]
        if kind in self.two_phase:
            early.sort(key=lambda x: x[2])
        for f, target, many in early:
            row[f] = self._follow(obj[f], target, many)
        key = repr(sorted(row.items()))
        if key in self.keys[kind]:
            return self.keys[kind][key]
        n = self.keys[kind][key] = len(self.lists[kind])
        self.lists[kind].append(row)
        for f, target, many in links:
            if (kind, f) in self.circular:
                row[f] = self._follow(obj[f], target, many)
        return n

    def _follow(self, held, target, many):
        if many:
            return [self.enter(target, x) for x in held or []]
        return None if held is None else self.enter(target, held)
