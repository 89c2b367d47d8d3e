"""A read-only page: the collections, and a search in one of them."""

PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>Collections</title>
<style>
body { font: 15px/1.5 system-ui, sans-serif; max-width: 60rem; margin: 2rem auto; padding: 0 1rem; }
table { border-collapse: collapse; width: 100%; } td, th { text-align: left; padding: .3rem .6rem; border-bottom: 1px solid #ccc; }
.hit { border: 1px solid #ccc; border-radius: 6px; margin: .6rem 0; padding: .6rem; } .hit small { color: #555; }
</style></head><body>
<h1>Collections</h1>
<label>API key <input id="key" type="password"></label> <button id="load">Load</button>
<table><thead><tr><th>Name</th><th>Dimension</th><th>Metric</th><th>Records</th></tr></thead><tbody id="names"></tbody></table>
<h2>Search</h2>
<form id="form"><select id="name"></select> <input id="text" size="40" placeholder="Text" required>
<label><input id="hybrid" type="checkbox"> with keywords</label> <button>Search</button></form>
<div id="hits"></div>
<script>
const at = id => document.getElementById(id);
const call = async (path, body) => {
  const headers = {"Content-Type": "application/json"};
  if (at("key").value) headers.Authorization = "Bearer " + at("key").value;
  const answer = await fetch(path, body ? {method: "POST", headers, body: JSON.stringify(body)} : {headers});
  const data = await answer.json();
  if (!answer.ok) throw new Error(data.detail);
  return data;
};
const element = (tag, text) => { const e = document.createElement(tag); e.textContent = text; return e; };
const load = async () => {
  const {indexes} = await call("/v1/indexes");
  at("names").replaceChildren(...indexes.map(i => { const r = element("tr", ""); r.append(...[i.name, i.dimension, i.metric, i.count].map(x => element("td", x))); return r; }));
  at("name").replaceChildren(...indexes.map(i => element("option", i.name)));
};
at("load").onclick = () => load().catch(e => alert(e.message));
at("form").onsubmit = async event => {
  event.preventDefault();
  try {
    const {matches} = await call(`/v1/indexes/${at("name").value}/query`, {text: at("text").value, hybrid: at("hybrid").checked});
    at("hits").replaceChildren(...matches.map(m => {
      const box = element("div", ""); box.className = "hit";
      box.append(element("small", `${m.id}, ${m.score.toFixed(3)}, ${m.metadata.source ?? ""} ${m.metadata.chunk ?? ""}`), element("div", (m.metadata.text ?? "").slice(0, 400)));
      return box;
    }));
  } catch (e) { alert(e.message); }
};
load().catch(() => {});
</script></body></html>
"""
