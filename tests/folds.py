"""Plain sequential folds that state the semantics row by row."""


def changes(rows, key, watch, null_mode="sticky"):
    """rows in order -> kept rows."""
    state, kept = {}, []
    for r in rows:
        new = [r[c] for c in watch]
        old = state.get(r[key])
        if null_mode == "sticky":
            hit = old is None or any(a is not None and b is not None and a != b for a, b in zip(old, new))
            after = new
        else:
            old = old or [None] * len(watch)
            hit = any(b is not None and a != b for a, b in zip(old, new))
            after = [a if b is None else b for a, b in zip(old, new)]
        if hit:
            state[r[key]] = after
            kept.append(r)
    return kept


def confirm(rows, n):
    """(session, frame, name, sure) in order -> {session: (frame, name)}."""
    state, out = {}, {}
    for session, frame, name, sure in rows:
        if session in out or not sure:
            continue
        last, count = state.get(session, (None, 0))
        count = count + 1 if name == last else 1
        state[session] = (name, count)
        if count >= n:
            out[session] = (frame, name)
    return out
