"""Pages with a marked main text for tests of the extraction."""

from __future__ import annotations

import random
from collections.abc import Iterator

from trackloom.llm.html_extract import MARK


def template_pages(n: int, seed: int) -> Iterator[str]:
    """Pages of other templates than those that the weights come from; the main text is marked."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f k l m n p r s t v".split() for b in "a e i o u".split()]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    says = lambda k: " ".join(word() for _ in range(k))
    main = lambda k: " ".join(MARK + word() for _ in range(k))
    links = lambda k: "".join(f'<li><a href="/{word()}">{says(rng.randint(1, 3))}</a></li>' for _ in range(k))

    def paragraph() -> str:
        text = main(rng.randint(4, 90))
        if rng.random() < 0.3:
            text += f" <a href='/x'>{main(3)}</a> <b>{main(2)}</b>"
        return f"<p>{text}</p>" if rng.random() < 0.9 else f"<p>{text}<br>{main(5)}"

    for _ in range(n):
        body = f"<h1>{main(rng.randint(3, 9))}</h1>" + "".join(paragraph() for _ in range(rng.randint(1, 14)))
        if rng.random() < 0.3:
            body += f"<h2>{main(3)}</h2><ul>" + "".join(f"<li>{main(8)}</li>" for _ in range(3)) + "</ul>" + paragraph()
        layout = rng.randrange(4)
        if layout < 3 and rng.random() < 0.4:
            body += rng.choice((f'<div class="ad">{says(6)}</div>', f'<aside>{says(12)}</aside>', f'<div class="share"><a href="/s">{says(1)}</a></div>')) + paragraph()
        named = layout != 3
        nav = f"<nav><ul>{links(6)}</ul></nav>" if rng.random() < 0.5 else f"<div{' class=\"menu\"' if named else ''}><ul>{links(6)}</ul></div>"
        extra = [f'<div class="ad">{says(9)}</div>', f'<aside><h3>{says(2)}</h3><ul>{links(4)}</ul></aside>', f'<div class="cookie-notice">{says(14)}<button>{says(1)}</button></div>'] if named else [f"<div><ul>{links(5)}</ul></div>"]
        rng.shuffle(extra)
        comments = f'<section id="comments"><h3>{says(1)}</h3>' + "".join(f"<p>{says(rng.randint(5, 40))}</p>" for _ in range(rng.randint(0, 6))) + "</section>" if named else ""
        holder = (f"<article>{body}</article>", f'<div class="post-content">{body}</div>', f"<main>{body}</main>", f"<div>{body}</div>")[layout]
        foot = f"<footer>{says(8)}</footer>" if rng.random() < 0.6 or not named else f'<div id="footer">{says(8)}<ul>{links(3)}</ul></div>'
        cut = rng.randint(0, len(extra))
        yield f"<html><head><title>{says(5)}</title></head><body><header>{says(3)}</header>{nav}{''.join(extra[:cut])}{holder}{''.join(extra[cut:])}{comments}{foot}</body></html>"
