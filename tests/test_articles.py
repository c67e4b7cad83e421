"""Article XML as it comes: references, CDATA, quotes, empty elements, comments, broken records."""

from papergraph.sources.articles import parse_articles, read_articles


def article(inner):
    return f"<PubmedArticle><MedlineCitation><PMID Version='1'>7</PMID><Article>{inner}</Article></MedlineCitation></PubmedArticle>"


def read(spark, *xml):
    return parse_articles(spark.createDataFrame([(x,) for x in xml], "xml string")).collect()


def test_references_and_cdata(spark):
    title = "TNF-&#x3b1; &#8211; a <![CDATA[x<y]]> <i>b</i> &amp; &lt;c&gt; &#60;d&#x3E; &#38;lt; &#128512; <![CDATA[<i>&amp;</i>]]>"
    row = read(spark, article(f"<ArticleTitle>{title}</ArticleTitle>"))[0]
    assert row.title == "TNF-α – a x<y b & <c> <d> &lt; 😀 <i>&amp;</i>"


def test_attributes_and_sections(spark):
    sections = "<AbstractText Label='AIM' NlmCategory=\"A>B\">p &lt; <b>1</b> tail</AbstractText><AbstractText NlmCategory='x' Label = \"R &amp; D 'q'\">two</AbstractText><AbstractText Label=\"NONE\"/><AbstractText/><AbstractText>three</AbstractText>"
    row = read(spark, article(f"<Abstract>{sections}</Abstract>"))[0]
    assert row.abstract == "AIM: p < 1 tail\nR & D 'q': two\nNONE: \nthree"


def test_empty_elements_comments_and_instructions(spark):
    lists = "<KeywordList><Keyword MajorTopicYN='N'/><Keyword>a<!-- <Keyword>no</Keyword> --></Keyword><Keyword > b <?x y?>c</Keyword ></KeywordList>"
    people = "<AuthorList><Author ValidYN='Y'><LastName>L&#243;</LastName><ForeName/></Author><Author><CollectiveName>G</CollectiveName><AffiliationInfo><Affiliation>X &amp; Y</Affiliation></AffiliationInfo><AffiliationInfo><Affiliation>Z</Affiliation></AffiliationInfo></Author></AuthorList>"
    row = read(spark, article(lists + people + "<ELocationID EIdType='doi'>10.1/e</ELocationID>"))[0]
    assert row.keywords == ["a", "b c"] and [a.name for a in row.authors] == ["Ló", "G"] and row.authors[1].affiliation == "X & Y; Z" and row.doi == "10.1/e"


def test_lists_and_identifiers(spark):
    inner = """<ChemicalList><Chemical><RegistryNumber>0</RegistryNumber><NameOfSubstance UI="D1">a &#x26; b</NameOfSubstance></Chemical><Chemical><RegistryNumber>1</RegistryNumber></Chemical></ChemicalList>
<PublicationTypeList><PublicationType UI='x'>Review</PublicationType></PublicationTypeList><GrantList><Grant><GrantID>7</GrantID></Grant><Grant><Country>C</Country></Grant><Grant><Agency>NIH</Agency></Grant></GrantList>
<MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN='N'>D</DescriptorName><QualifierName MajorTopicYN='Y'>q</QualifierName><QualifierName MajorTopicYN='N'>p</QualifierName></MeshHeading><MeshHeading><DescriptorName MajorTopicYN="Y">E</DescriptorName></MeshHeading></MeshHeadingList>
<ArticleIdList><ArticleId IdType="pubmed">7</ArticleId><ArticleId IdType='DOI'>10.1/a</ArticleId></ArticleIdList><ELocationID EIdType="doi">10.1/e</ELocationID>"""
    row = read(spark, article(inner))[0]
    assert [tuple(c) for c in row.chemical_terms] == [("a & b", "0")] and row.publication_types == ["Review"] and [(g.id, g.agency) for g in row.grant_info] == [("7", ""), ("", "NIH")]
    assert [tuple(m) for m in row.mesh_terms] == [("D", "q", True), ("D", "p", False), ("E", None, True)] and row.mesh_qualifiers == ["p", "q"] and row.doi == "10.1/a"


def test_broken_records_alone_are_left_out(spark, tmp_path):
    good = [article(f"<ArticleTitle>t{i}</ArticleTitle>").replace(">7<", f">{i}<") for i in range(3)]
    broken = ["<PubmedArticle><PMID>8<ArticleTitle>x</PubmedArticle>", "<PubmedArticle><PMID>9</PMID><ArticleTitle>a & b</ArticleTitle></PubmedArticle>", "<PubmedArticle><ArticleTitle>no id</ArticleTitle></PubmedArticle>"]
    head = '<?xml version="1.0"?>\n<!DOCTYPE PubmedArticleSet PUBLIC "a" "b">\n<PubmedArticleSet>'
    (tmp_path / "a.xml").write_text(head + good[0] + broken[0] + "\n" + good[1] + broken[1] + broken[2] + good[2] + "</PubmedArticleSet>")
    (tmp_path / "b.xml").write_text(head + "</PubmedArticleSet>")
    assert sorted((r.pmid, r.title, r.query_used) for r in read_articles(spark, str(tmp_path), "q").collect()) == [(str(i), f"t{i}", "q") for i in range(3)]


def test_prefixes_and_invalid_numbers(spark):
    row = read(spark, article("<ArticleTitle>a <mml:math><mml:mi>x</mml:mi></mml:math> b</ArticleTitle>"))[0]
    assert row.title == "a x b"
    assert read(spark, article("<ArticleTitle>a &#xD800; b</ArticleTitle>"), article("<ArticleTitle>&#0;</ArticleTitle>"), "", None) == []


def test_elements_are_made_plain_once(spark):
    rows = parse_articles(spark.createDataFrame([(article("<ArticleTitle>a</ArticleTitle>"),)], "xml string")).select("pmid", "title", "pub_date")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!\\[CDATA") == 1 and plan.count("<Month") == 2  # of the article's and of the issue's date
