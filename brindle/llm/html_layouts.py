"""The labelled table of page layouts from which the tree of html_extract grows.

Each line is the body of a page. ``{n}`` stands for n words; a block is main text if it starts with ``+``. The layouts
are of kinds that pages on the web have: news, blogs, manuals, shops, forums, recipes, verse, old tables, pages that
are one form, pages without any element that says where the text is, and pages whose elements say it wrongly.
"""

# Labelled by hand.
LAYOUTS = """
<nav><ul><li><a href=x>{1}</a><li><a href=x>{1}</a><li><a href=x>{1}</a></ul></nav><div>{7}</div><article><h1>+{9}</h1><p>+{45}</p><p>+{80}</p><p>+{30}</p></article><footer>{12}</footer>
<nav><a href=x>{1}</a> <a href=x>{1}</a> <a href=x>{2}</a></nav><div>{12}</div><article><h1>+{6}</h1><p>+{8}</p></article><footer>{4}</footer>
<nav><ul><li><a href=x>{1}</a><li><a href=x>{2}</a></ul></nav><div>{5}</div><article><h1>+{12}</h1><p>+{20}<br>+{14}</p><p>+{3}</p><p>+{150}</p></article><footer>{15}</footer>
<header><h1>{2}</h1><p>{6}</p></header><nav><ul><li><a href=x>{1}</a><li><a href=x>{1}</a></ul></nav><main><article><h2>+{7}</h2><p>+{60}</p><h3>+{3}</h3><p>+{40}</p><ul><li>+{6}<li>+{9}<li>+{5}</ul><p>+{25}</p></article></main><aside><h3>{2}</h3><ul><li><a href=x>{6}</a><li><a href=x>{8}</a></ul></aside><footer>{9}</footer>
<header><a href=x>{2}</a></header><article><header><h1>+{8}</h1></header><p>+{35}</p><blockquote>+{22}</blockquote><p>+{55}</p><figure><figcaption>+{7}</figcaption></figure><p>+{70}</p><footer>{8}</footer></article><section><h2>{1}</h2><article><p>{24}</p></article><article><p>{16}</p></article><article><p>{48}</p></article></section><footer>{6}</footer>
<div><a href=x>{1}</a> <a href=x>{1}</a></div><article><h1>+{5}</h1><p>+{90}</p><div>+{30}</div><p>+{18}</p></article><div><article><p>{40}</p></article></div><div><article><p>{70}</p></article></div><div>{3}</div>
<div><article><p>{85}</p></article></div><div><article><p>{30}</p></article></div><article><h1>+{7}</h1><p>+{60}</p><p>+{45}</p></article><footer>{5}</footer>
<div><article><p>{52}</p></article></div><article><h1>+{2}</h1><p>+{31}</p><p>+{29}</p></article>
<article><h1>+{2}</h1><p>+{31}</p><p>+{29}</p></article><section><article><p>{52}</p></article></section>
<div><article><p>{58}</p></article></div><article><h1>+{2}</h1><p>+{31}</p><p>+{29}</p></article>
<article><h1>+{3}</h1><p>+{26}</p><p>+{22}</p></article><div><article><p>{66}</p></article><article><p>{12}</p></article></div>
<article><p>+{40}</p><p>+{64}</p></article><div><article><p>{26}</p></article><article><p>{9}</p></article></div>
<article><h1>+{6}</h1><p>+{50}</p><p>+{65}</p><ul><li><a href=x>{3}</a><li><a href=x>{4}</a><li><a href=x>{3}</a></ul></article><div><p>{28}</p></div><footer>{10}</footer>
<article><h1>+{6}</h1><div><a href=x>{1}</a> <a href=x>{1}</a> <a href=x>{1}</a></div><div><a href=x>{2}</a></div><p>+{44}</p><p>+{71}</p><p><a href=x>+{6}</a></p><p>+{38}</p></article>
<article><p>+{120}</p><p><a href=x>+{9}</a></p><p>+{60}</p><p>+{30}</p><p><a href=x>{4}</a></p><p><a href=x>{5}</a></p><p><a href=x>{4}</a></p></article>
<article><h1>+{4}</h1><p>+{10} <a href=x>{6}</a> {30}</p><p>+{14} <a href=x>{3}</a></p><p>+{40} <a href=x>{2}</a> {9} <a href=x>{4}</a></p><pre>+{25}</pre><p>+{3} <a href=x>{2}</a></p></article>
<div>{3}</div><main><h1>+{5}</h1><p>+{33}</p><h2>+{3}</h2><p>+{52}</p><section><h2>+{4}</h2><p>+{41}</p><ol><li>+{12}<li>+{9}<li>+{15}</ol></section></main><div><p>{25}</p></div><footer>{8}</footer>
<div><p>{29}</p></div><article><h1>+{2}</h1><p>+{31}</p><p>+{29}</p></article>
<article><h1>+{2}</h1><p>+{31}</p><p>+{29}</p></article><div><p>{29}</p></div>
<div><p>{60}</p><p>{14}</p></div><article><h1>+{8}</h1><p>+{80}</p><p>+{110}</p></article><div>{30}</div><div><p>{40}</p></div>
<article><p>+{31}</p></article><section><h2>+{1}</h2><p>+{29}</p></section>
<article><p>+{50}</p><p>+{26}</p></article><section><h2>+{3}</h2><p>+{45}</p><p>+{38}</p></section><section><h2>{2}</h2><p>{12}</p></section>
<section><h2>+{2}</h2><p>+{60}</p></section><article><h1>+{4}</h1><p>+{55}</p></article><section><h3>{1}</h3><ul><li><a href=x>{5}</a><li><a href=x>{7}</a></ul></section>
<section><h1>+{4}</h1><p>+{55}</p><p>+{48}</p></section><section><h2>+{3}</h2><p>+{66}</p></section><section><h2>{2}</h2><ul><li><a href=x>{4}</a><li><a href=x>{5}</a></ul></section><footer>{5}</footer>
<nav><a href=x>{1}</a></nav><section><h2>+{2}</h2><p>+{30}</p><p>+{12}</p></section><section><h2>+{2}</h2><p>+{34}</p></section><footer>{20}</footer>
<article><h2>+{6}</h2><p>+{50}</p></article><article><h2>+{7}</h2><p>+{44}</p></article><article><h2>+{5}</h2><p>+{58}</p></article><nav><a href=x>{2}</a></nav>
<article><h2>+{6}</h2><p>+{120}</p><p>+{30}</p></article><article><h2>+{4}</h2><p>+{70}</p></article><aside><p>{45}</p></aside>
<main><article><h1>+{6}</h1><p>+{60}</p><p>+{90}</p></article><div><h2>{2}</h2><article><a href=x>{6}</a></article><article><a href=x>{7}</a></article><article><a href=x>{5}</a></article></div></main>
<article><h1>+{2}</h1><p>+{31}</p><p>+{29}</p></article><div><article><a href=x>{4}</a></article><article><a href=x>{4}</a></article><article><a href=x>{4}</a></article></div>
<div><article><a href=x>{4}</a></article><article><a href=x>{4}</a></article></div><article><h1>+{2}</h1><p>+{31}</p><p>+{29}</p></article>
<main><article><h1>+{5}</h1><p>+{150}</p></article><article><h3><a href=x>{6}</a></h3><p>{18}</p></article><article><h3><a href=x>{5}</a></h3><p>{22}</p></article></main>
<main><h1>+{7}</h1><article><p>+{70}</p><p>+{45}</p></article><div>{3}</div><div><a href=x>{2}</a></div></main><footer>{5}</footer>
<aside><h2>{2}</h2><p>{60}</p><p>{20}</p></aside><article><h1>+{4}</h1><p>+{58}</p><p>+{35}</p><aside><p>{25}</p></aside><p>+{49}</p></article>
<form><label>{2}</label><label>{2}</label></form><article><h1>+{5}</h1><p>+{65}</p><form><p>{9}</p><label>{2}</label></form><p>+{40}</p></article><form><p>{14}</p></form>
<form><div><ul><li><a href=x>{1}</a><li><a href=x>{2}</a></ul></div><div><h1>+{4}</h1><p>+{60}</p><p>+{75}</p><p>+{22}</p></div><div>{6}</div></form>
<form><p>+{45}</p><p>+{60}</p><p>+{38}</p></form><form><label>{1}</label><div>{5}</div></form>
<nav><p>{14}</p><p>{35}</p></nav><div><p>+{70}</p><p>+{44}</p></div><footer><p>{60}</p><p>{25}</p></footer>
<header><p>{30}</p></header><div><h1>+{3}</h1><p>+{33}</p><p>+{58}</p></div><aside><p>{48}</p></aside><footer><p>{35}</p></footer>
<div><ul><li><a href=x>{1}</a><li><a href=x>{1}</a><li><a href=x>{1}</a></ul></div><h1>+{6}</h1><p>+{48}</p><p>+{70}</p><h2>+{3}</h2><p>+{36}</p><div>{6}</div><div><a href=x>{1}</a> <a href=x>{2}</a></div>
<div><a href=x>{1}</a> {1} <a href=x>{1}</a> {1} <a href=x>{2}</a></div><div>{2}</div><div><h2>+{5}</h2><p>+{25}</p><p>+{64}</p><ul><li>+{7}<li>+{11}<li>+{8}</ul><p>+{52}</p></div><div><h3>{2}</h3><ul><li><a href=x>{3}</a><li><a href=x>{5}</a></ul></div><div>{7}</div>
<table><tr><td><a href=x>{1}</a><td><a href=x>{1}</a></tr></table><table><tr><td><a href=x>{2}</a><br><a href=x>{2}</a><br><a href=x>{1}</a><td>+{90}<br>+{60}<br>+{75}</tr></table><div>{8}</div>
<div>{1}</div><div>{2}</div><div>+{120}</div><div>+{85}</div><div>+{30}</div><div>{3}</div><div>{4}</div>
<div><a href=x>{3}</a></div><div>{9}</div><div><p>+{60}</p><p>+{12}</p><p>+{48}</p></div><div><p>{5}</p></div><div>{3} <a href=x>{2}</a></div>
<p>+{31}<p>+{29}
<div><p>+{31}<p>+{29}</div>
<nav><a href=x>{1}</a></nav><div><p>+{31}<p>+{29}</div>
<p>+{40}<p>+{55}<p>+{8}<p>+{62}
<p>+{25}<p>+{33}
<div>+{60}</div>
+{45}<br>+{30}<br>+{26}
<h1>+{3}</h1><p>+{5}<br>+{6}<br>+{5}<br>+{7}<br>+{6}<br>+{5}<br>+{6}</p>
<article><h1>+{3}</h1><p>+{5}<br>+{6}<br>+{5}<br>+{7}</p><p>+{6}<br>+{5}<br>+{6}<br>+{1}</p></article>
<div><a href=x>{2}</a></div><div><h1>+{4}</h1><p>+{4}<br>+{6}<br>+{5}<br>+{6}<br>+{5}</p></div><div>{4} <a href=x>{1}</a></div>
<div><a href=x>{1}</a> <a href=x>{1}</a></div><div><h1>+{4}</h1><p>+{28}</p><h2>+{1}</h2><ul><li>+{4}<li>+{5}<li>+{3}<li>+{4}</ul><h2>+{1}</h2><ol><li>+{14}<li>+{20}<li>+{11}</ol></div><div><a href=x>{4}</a></div><div><a href=x>{5}</a></div>
<article><h1>+{4}</h1><ul><li>+{4}<li>+{5}<li>+{3}</ul><ol><li>+{14}<li>+{20}<li>+{1}</ol><table><tr><td>+{1}<td>+{2}</tr><tr><td>+{1}<td>+{3}</tr></table></article><footer>{3}</footer>
<div><a href=x>{2}</a></div><div>{14}</div><div>{3}</div><div><a href=x>{4}</a></div><div><a href=x>{3}</a></div><div>{5}</div>
<ul><li><a href=x>{3}</a><li><a href=x>{4}</a><li><a href=x>{5}</a></ul><div>{4}</div><ul><li><a href=x>{3}</a><li><a href=x>{6}</a></ul><div>{9}</div>
<ul><li><a href=x>{8}</a> {6}<li><a href=x>{9}</a> {5}<li><a href=x>{7}</a> {8}</ul><div>{2}</div><div><a href=x>{1}</a></div>
<div>{13}</div><div><button>{1}</button></div><ul><li><a href=x>{1}</a><li><a href=x>{1}</a></ul><h1>+{7}</h1><p>+{85}</p><p>+{62}</p><p>+{17}</p><div>{2}</div><div>{8}</div>
<div><p>+{55}</p><p>+{38} <a href=x>{4}</a> {20}</p><p>+{22} <a href=x>{6}</a></p><p>+{47}</p></div><div><p><a href=x>{7}</a></p><p><a href=x>{8}</a></p><p><a href=x>{9}</a></p></div>
<main><p>+{18}</p><p>+{9}</p><p>+{26}</p></main><div>{11}</div>
<article>+{40}<p>+{30}</p>+{12}</article><div>{20}</div>
<article><p>+{9}</p></article><footer>{9}</footer><div>{9}</div>
<article><div><h1>+{3}</h1></div><p>+{31}</p><section><h2>+{1}</h2><p>+{29}</p><p>+{1}</p></section></article>
<article><div>+{9}</div><p>+{40}</p><div><p>+{12}</p><p>+{35}</p></div><div>+{45}</div><blockquote>+{6}</blockquote><p>+{60}</p></article>
"""
