"""Texts with the awkward characters, and a seeded mix of them."""

import random

EDGE = [
    None, "", " ", "nan", "Good", "50% off", "get 50%off", "50%_", "5%x", "50%é", "é50%x",
    "two words", "two　words", "unit\x1fseparator here", " leading", "trailing\x1c",
    "😀é", "ＷＷＷ.example", "WWW.EXAMPLE.COM now", "httpS://x", "http:// nothing", "visit bit.ly/x",
    "decode this", "ſave $ and ſo on", "save $5", "SAVE $5", "tinyurl", "İstanbul dİscount",
    "AAAAAAAAAAAAAAAAAAAAAAAA", "ÄÖÜÄÖÜÄÖÜÄÖÜÄÖÜÄÖÜÄÖÜ x", "ǅǅǅǅǅǅǅǅǅǅǅǅǅǅǅǅǅǅǅǅǅǅǅǅǅ",
    "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪ", "!!!!!", "!!!!!!", "٣٤% off ٣٤%x", "a\tb\nc\rd\x0be\x0cf g",
    "Don’t “go” — 5€−…٣ please", "ΑΣ ΑΣ ΑΣ ΑΣ ΑΣ", "\u0085next\u0085line", "zero​width here now ok",
    "Great food and service! Would definitely come back.",
    "GREAT FOOD AND SERVICE! WOULD DEFINITELY COME BACK.",
    " great food and service! would definitely come back. ",
    "I've been here, and it's the best; honestly (9/10) #food @place",
]


def rows(n, seed=7):
    """n (business, text) rows; about a third of them share one text and business."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if rng.random() < 0.33:
            out.append(("Hot place", "Great food and service! Would definitely come back."))
            continue
        text = rng.choice(EDGE)
        if text is not None and rng.random() < 0.4:
            text = f"{text} {rng.choice([t for t in EDGE if t])}"
        out.append((rng.choice([None, "A", "a", " A", "A:b", "nan"]), text))
    out += [("a:b", "c"), ("a", "b:c")]
    return out
