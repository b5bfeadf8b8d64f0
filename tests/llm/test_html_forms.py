"""Pages wrapped in a form."""

import pytest

from foliosmith.llm import htmltext

PARA = "One long para with text that goes on and on."


@pytest.mark.parametrize("inner, want", [
    (f"<article><h2>Title</h2><p>{PARA}</p></article>", f"Title\n{PARA}"),
    (f"<main><p>{PARA}</p></main>", PARA),
    (f"<div><h1>Title</h1><p>{PARA}</p></div>", f"Title\n{PARA}"),
])
def test_a_form_around_the_page_is_a_container(inner, want):
    controls = '<input type="hidden" value="v"><select><option>pick</option></select><button>Send</button><textarea>typed</textarea>'
    assert htmltext.main_text(f'<body><form class="aspnet" action="x"><nav><a href="a">Menu</a></nav>{inner}{controls}<footer>foot</footer></form></body>') == want


def test_other_forms_still_go():
    assert htmltext.main_text(f"<body><article><p>{PARA}</p><form><p>Your mail, please</p></form></article></body>") == PARA
    assert htmltext.main_text(f"<body><div><p>{PARA}</p></div><aside><article><p>Related</p></article></aside></body>") == PARA
