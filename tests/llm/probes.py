"""Pages in layouts that neither the driver's tables nor the invented training pages have, with their main text."""

_A = "The council met on Tuesday evening to decide on the new bridge, and most members spoke in favour of the plan."
_B = "Work on the northern bank starts in spring; the old crossing stays open until the last pillar is built."
_C = "Costs are higher than expected, but the province pays two thirds of them, as the mayor said on Monday."
_ARTICLE = f"<h1>A new bridge</h1><p>{_A}</p><p>{_B}</p><p>{_C}</p>"
_TEXT = "\n\n".join(["A new bridge", _A, _B, _C])
_MENU = "<ul>" + "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("home", "news", "sport", "weather", "contact")) + "</ul>"
_COMMENTS = "<div class=comment><p>I do not like this plan at all.</p></div><div class=comment><p>Great news, well written!</p></div>"

PAGES = {
    "apostrophe in an unquoted value": (f"<html><body><nav>{_MENU}</nav><article><h1>A new bridge</h1><p data-a=it's>{_A}</p><p>{_B} don't</p><p>{_C}</p></article></body></html>", "\n\n".join(["A new bridge", _A, _B + " don't", _C])),
    "apostrophe and no later one": (f"<html><body><article><h1>A new bridge</h1><p data-a=it's>{_A}</p><p>{_B}</p><p>{_C}</p></article></body></html>", _TEXT),
    "comments after the article": (f"<html><body><nav>{_MENU}</nav><article>{_ARTICLE}</article><section id=comments>{_COMMENTS}</section></body></html>", _TEXT),
    "comments inside the article": (f"<html><body><nav>{_MENU}</nav><article>{_ARTICLE}<section id=comments>{_COMMENTS}</section></article></body></html>", _TEXT),
    "footer behind main": (f"<html><body><main>{_ARTICLE}</main><footer><p>Copyright 2024 The Daily Example, all rights reserved.</p></footer></body></html>", _TEXT),
    "footer behind article": (f"<html><body><article>{_ARTICLE}</article><footer><p>Copyright 2024 The Daily Example, all rights reserved.</p></footer></body></html>", _TEXT),
    "menu of one link": (f"<html><body><nav><a href=/>Home</a></nav><article>{_ARTICLE}</article></body></html>", _TEXT),
    "long menu": (f"<html><body><nav>{_MENU * 6}</nav><article>{_ARTICLE}</article></body></html>", _TEXT),
    "plain div": (f"<html><body><div>{_MENU}</div><div>{_ARTICLE}</div></body></html>", _TEXT),
    "sidebar and form": (f"<html><body><div id=wrap><aside><p>Most read this week</p>{_MENU}</aside><div class=content>{_ARTICLE}</div><form><p>Sign up</p></form></div></body></html>", _TEXT),
}
