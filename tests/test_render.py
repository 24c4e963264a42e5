from quarrymill.sources import render


def test_page(tmp_path):
    (tmp_path / "a.png").write_bytes(b"png")
    out = render.page("# T\n\nhi **you**\n\n## One & two\n\n| a | b |\n|---|--:|\n| x | `1` |\n\n- p\n- q\n\n> said\n\n```mermaid\ngraph LR\n```\n\n## Pics\n\n![i](a.png) ![j](gone.png)\n", str(tmp_path))
    assert "<title>T</title>" in out and "<b>you</b>" in out and '<details open id="s0"><summary>One &amp; two</summary>' in out
    assert '<td style="text-align:right"><code>1</code></td>' in out and "<ul><li>p</li><li>q</li></ul>" in out and "<blockquote>said</blockquote>" in out
    assert '<pre class="mermaid">' in out and "mermaid/+esm" in out and "data:image/png;base64,cG5n" in out and 'src="gone.png"' in out
    assert "mermaid" not in render.page("# x\n\n1. a\n2. b\n")
