"""Row-by-row models the distributed folds are compared with."""


def admit(requests, capacity, slack=0):
    """{(key, pos): (granted, before, after)} for requests (key, pos, amount)."""
    state = {k: [c, c] for k, c in capacity.items()}
    out = {}
    for key, pos, x in sorted(requests):
        guard, shown = state.get(key, [None, None])
        before = shown
        granted = guard is not None and 0 < x <= guard
        if granted:
            shown = guard - x
            guard = 0 if slack and shown == 1 else shown
            state[key] = [guard, shown]
        out[(key, pos)] = (granted, before, shown)
    return out


def ledger(events, lines, plans, strict=True, minimum=50000):
    """Outcomes, final lines and final plans for events (user, pos, kind, cents, instalments, plan)."""
    state = {u: {"t": t, "d": d, "c": c, "on": s == "activo"} for u, (t, d, c, s) in lines.items()}
    book = {(u, p): [value, total, paid] for u, p, value, total, paid in plans}
    out = {}
    for user, pos, kind, x, parts, plan in sorted(events, key=lambda e: e[:2]):
        s = state.get(user)
        ok = False
        if kind == "usar" and x and x > 0 and parts and s and s["on"] and x <= s["d"]:
            ok = True
            s["d"] -= x
            book[(user, plan)] = [(2 * x + parts) // (2 * parts), parts, 0]
        elif kind == "pagar_cuota" and s and (user, plan) in book:
            p = book[(user, plan)]
            ok = not (strict and p[2] >= p[1])
            if ok:
                p[2] += 1
                s["d"] = min(s["d"] + p[0], s["t"])
                if p[2] >= p[1]:
                    s["c"] += 1
                    if s["c"] % 3 == 0:
                        s["t"] = s["d"] = min(s["t"] + 50000_00, 500000_00)
        elif kind == "liquidar" and s and s["t"] > s["d"]:
            ok = True
            s["d"] = s["t"]
            for (u, _), p in book.items():
                if u == user:
                    p[2] = max(p[2], p[1])
        elif kind == "ajustar" and x is not None and x >= minimum * 100:
            ok = True
            s = state.setdefault(user, {"c": 0, "on": True})
            s["t"] = s["d"] = x
        out[(user, pos)] = (ok, s and s["t"], s and s["d"], s["c"] if s else 0)
    return out, state, book
