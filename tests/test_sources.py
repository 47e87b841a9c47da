from sightline.operators import flow, graph, resolution
from sightline.sources import code_index, manifest

JAVA = '''package app.demo;
// class Ghost { void none() {} }
public class Entry extends Base {
    String text = "call(1, 2) { }";
    public void onStart(Intent in, int flags) throws IOException {
        Mid mid = new Mid();
        mid.handle(in.getData(), other(1, "a,b"));
        this.other(2, null);
        missing();
    }
    private int other(int a, String b) { return a; }
    static class Inner { void go() { other(); } }
}
'''
MID = "package app.demo;\nclass Mid {\n  void handle(Object o, int n) { Leaf.run(o); }\n}\n"


def test_structure_and_call_resolution(spark, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "app/Entry.java").write_text(JAVA)
    (tmp_path / "app/Mid.java").write_text(MID)
    (tmp_path / "app/note.txt").write_text("class No {}")
    (tmp_path / "app/Huge.kt").write_text("// " + "x" * 600_000)
    files, skipped = code_index.scan(spark, str(tmp_path))
    assert skipped.count() == 1
    assert code_index.scan(spark, str(tmp_path), ["app.Huge"])[1].count() == 0
    rows = code_index.structure(files).cache()
    assert {r["name"] for r in rows.where("kind = 'class'").collect()} == {"Entry", "Inner", "Mid"}
    methods = {(r["class_name"], r["name"]): (r["arity"], r["start_line"]) for r in rows.where("kind = 'method'").collect()}
    assert methods == {("Entry", "onStart"): (2, 5), ("Entry", "other"): (2, 11), ("Inner", "go"): (0, 12), ("Mid", "handle"): (2, 3)}
    sites = {(r["caller"], r["name"]): r["status"] for r in code_index.call_sites(rows).collect()}
    assert sites["onStart", "handle"] == "resolved" and sites["onStart", "other"] == "resolved"
    assert sites["onStart", "missing"] == "pending" and sites["go", "other"] == "pending"
    assert code_index.structure(spark.createDataFrame([("a", None)], "path string, content string")).count() == 0


def test_mask_keeps_length_and_lines():
    source = 'a("x//y"); // z\n/* b\n c */ d'
    masked = code_index.mask(source)
    assert len(masked) == len(source) and masked.count("\n") == 2 and "z" not in masked and masked.endswith(" d")


XML = """<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="app.demo"><uses-sdk android:targetSdkVersion="30"/>
<application android:permission="app.P"><activity android:name=".Main"><intent-filter><action android:name="a"/></intent-filter></activity>
<activity android:name="other.pack.View" android:exported="false" android:permission="own"/><service android:name="Sync" android:exported="@bool/x"/>
<provider android:name=".Data"/></application></manifest>"""


def test_manifest_components(spark):
    rows = spark.createDataFrame([(XML,), (None,), ("<broken",)], "xml string")
    found = {r["name"]: (r["kind"], r["exported"], r["permission"], r["n_actions"]) for r in manifest.components(rows).collect()}
    assert found == {
        "app.demo.Main": ("activity", "true", "app.P", 1),
        "other.pack.View": ("activity", "false", "own", 0),
        "app.demo.Sync": ("service", "unknown", "app.P", 0),
        "app.demo.Data": ("provider", "false", "app.P", 0),
    }


def test_flow_to_sinks(spark):
    t = spark.createDataFrame([("a", 0, "b", 1), ("b", 1, "c", 0), ("c", 0, "a", 0), ("d", 0, "v", 0), ("v", 0, "c", 0), ("e", 0, "f", 0)], "method string, slot int, to_method string, to_slot int")
    sinks, checked = spark.createDataFrame([("c", 0)], "method string, slot int"), spark.createDataFrame([("v", 0)], "method string, slot int")
    found = {(r["method"], r["slot"]): r["hops"] for r in flow.reaching_sinks(t, sinks, checked).collect()}
    assert found == {("c", 0): 0, ("b", 1): 1, ("a", 0): 2}


def test_graph_limits_and_nulls(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(5, 0), (None, 1), (1, None)], "src long, dst long")
    seeds = spark.createDataFrame([(0,), (0,), (None,)], "vertex long")
    assert graph.reach(edges, seeds).count() == 7
    assert graph.tree(edges, seeds.where("vertex = 0").limit(1), depth_limit=2)[1] == "depth_limit"
    assert graph.tree(edges, seeds.where("vertex = 0").limit(1), node_limit=3)[1] == "node_limit"
    assert graph.reach(edges.limit(0), seeds).count() == 1 and graph.reach(edges, seeds.limit(0)).count() == 0


def test_resolution_of_null_keys(spark):
    calls = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "c")], "id int, k string")
    targets = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b"), (13, None)], "t int, k string")
    assert {r["id"]: r["status"] for r in resolution.by_key(calls, targets, ["k"], "t").collect()} == {1: "resolved", 2: "pending", 3: "ambiguous", 4: "pending"}
