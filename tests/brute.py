"""Plain restatements of the matching rules, for small fixtures."""


def match_one(member, messages, policy, max_age, lookahead):
    """(reason, source time) of one membership row, by looking at every message."""
    _, _, _, time, agent, is_member, expected = member
    mine = [m for m in messages if m[2] == agent]
    if not is_member:
        return "not_member", None
    if not expected or not mine:
        return "missing_message", None
    limit = time + lookahead
    usable = [m for m in mine if m[3] <= limit and m[4] <= limit]
    if usable:
        if policy == "causal_backward":
            best = max(usable, key=lambda m: m[3])
        else:
            best = min(usable, key=lambda m: (abs(time - m[3]), m[3] > time))
        age = time - best[3]
        if abs(age) > max_age:
            return ("stale" if age > 0 else "out_of_range"), None
        return ("empty_scene" if best[5] else "matched" if best[6] else "invalid_pose"), best[3]
    if any(m[3] <= limit and abs(time - m[3]) <= max_age for m in mine):
        return "late", None
    if all(m[3] > limit for m in mine):
        return "unmatched", None
    return ("stale" if any(m[3] < time for m in mine) else "out_of_range"), None
