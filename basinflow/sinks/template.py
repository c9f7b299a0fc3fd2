"""The page's text: what decodes its data, and what shows it."""

from __future__ import annotations

#: Functions without a document: decoders, bins, the nearest frame, pins as text.
CODEC = r"""
"use strict";
const bytesOf = (text) => Uint8Array.from(atob(text), (c) => c.charCodeAt(0));
const through = async (bytes, stream) => new Uint8Array(await new Response(new Blob([bytes]).stream().pipeThrough(stream)).arrayBuffer());
const inflate = (text) => through(bytesOf(text), new DecompressionStream("deflate"));
const asText = (bytes) => new TextDecoder().decode(bytes);

function decodeGrid(block) {
  const raw = bytesOf(block.data), view = new DataView(raw.buffer), ny = block.shape[1], wide = block.type === "<u4";
  return (x, y) => (wide ? view.getUint32(4 * (x * ny + y), true) : view.getUint16(2 * (x * ny + y), true));
}

async function decodeColumns(block) {
  const columns = JSON.parse(asText(await inflate(block.data)));
  const plain = (c) => ("raw" in c ? c.raw : c.at.map((i) => (i < 0 ? null : c.values[i])));
  const all = block.names.map((n) => plain(columns[n]));
  return Array.from({ length: block.count }, (_, i) => Object.fromEntries(block.names.map((n, k) => [n, all[k][i]])));
}

async function decodeStructures(block) {
  const [keys, comments] = JSON.parse(asText(await inflate(block.index)));
  const raw = await inflate(block.data), size = 3 * block.atoms * block.count, found = new Map();
  const x = keys.map(() => new Float64Array(3 * block.atoms));
  for (let c = 0; c < 3 * block.atoms; c++) {
    let sum = 0;
    for (let i = 0; i < block.count; i++) {
      const at = c * block.count + i, code = raw[at] + 256 * raw[at + size] + 65536 * raw[at + 2 * size];
      sum += code % 2 ? -(code + 1) / 2 : code / 2;
      x[i][c] = sum * block.step;
    }
  }
  keys.forEach((k, i) => found.set(k, { comment: comments[i], elements: block.elements, x: x[i] }));
  return found;
}

function parseXyz(text) {
  const lines = text.split("\n"), n = parseInt(lines[0]), x = new Float64Array(3 * n), elements = [];
  for (let i = 0; i < n; i++) {
    const f = lines[i + 2].trim().split(/\s+/);
    elements.push(f[0]);
    for (let k = 0; k < 3; k++) x[3 * i + k] = parseFloat(f[k + 1]);
  }
  return { comment: lines[1], elements, x };
}

function writeXyz(s) {
  const rows = s.elements.map((e, i) => e.padEnd(2) + " " + [0, 1, 2].map((k) => s.x[3 * i + k].toFixed(8)).join(" "));
  return [s.elements.length, s.comment, ...rows].join("\n") + "\n";
}

function binOf(value, edges) {
  const n = edges.length - 1;
  if (!(value >= edges[0] && value <= edges[n])) return -1;
  let i = Math.min(n - 1, Math.floor(((value - edges[0]) / (edges[n] - edges[0])) * n));
  if (value < edges[i]) i--;
  else if (i < n - 1 && value >= edges[i + 1]) i++;
  return i;
}

function nearest(records, x, y, spanX, spanY, periodic) {
  const gap = (a, b, span) => {
    const d = Math.abs(a - b);
    return (periodic ? Math.min(d, 360 - d) : d) / span;
  };
  let best = null, least = Infinity;
  for (const r of records) {
    const d = gap(r.x, x, spanX) ** 2 + gap(r.y, y, spanY) ** 2;
    if (d < least) [best, least] = [r, d];
  }
  return best;
}

async function pinsToLink(pins) {
  const packed = await through(new TextEncoder().encode(JSON.stringify(pins)), new CompressionStream("gzip"));
  return btoa(String.fromCharCode(...packed)).replaceAll("+", "-").replaceAll("/", "_").replaceAll("=", "");
}

async function pinsFromLink(link) {
  try {
    const pins = JSON.parse(asText(await through(bytesOf(link.replaceAll("-", "+").replaceAll("_", "/")), new DecompressionStream("gzip"))));
    return Array.isArray(pins) ? pins.filter((p) => typeof p === "string") : [];
  } catch {
    return [];
  }
}
"""

_VIEW = r"""
"use strict";
const d = JSON.parse(document.getElementById("data").textContent), $ = (i) => document.getElementById(i);
const g = d.grid, nx = g.nx, ny = g.ny, left = 56, size = 600, count = decodeGrid(d.counts);
const x0 = g.xe[0], x1 = g.xe[nx], y0 = g.ye[0], y1 = g.ye[ny];
const px = (x) => left + ((x - x0) / (x1 - x0)) * size, py = (y) => 8 + (1 - (y - y0) / (y1 - y0)) * size;
const ctx = $("map").getContext("2d"), mol = $("mol").getContext("2d");
let top_ = 0, records = [], byBin = new Map(), structures = new Map(), pins = [], shown = null, turn = [0.4, 0.6];
for (let x = 0; x < nx; x++) for (let y = 0; y < ny; y++) top_ = Math.max(top_, count(x, y));

const thermal = () => {
  const u = d.units.find((v) => v.key === $("unit").value);
  return u.k === null ? 1 : u.k * parseFloat($("kelvin").value);
};
const value = (x, y) => {
  const c = count(x, y), mode = $("mode").value;
  return !c ? null : mode === "log" ? Math.log10(c + 1) : mode === "count" ? c : thermal() * Math.log(top_ / c);
};
const tint = (t) => {
  const s = d.colours.scale, at = t * (s.length - 1), i = Math.min(s.length - 2, Math.floor(at));
  return "rgb(" + s[i].map((a, k) => Math.round(a + (at - i) * (s[i + 1][k] - a))).join() + ")";
};
const stateColour = (k) => d.colours.states[k % d.colours.states.length];

function draw() {
  ctx.clearRect(0, 0, 700, 660);
  let low = Infinity, high = -Infinity;
  for (let x = 0; x < nx; x++) for (let y = 0; y < ny; y++) {
    const v = value(x, y);
    if (v !== null && isFinite(v)) [low, high] = [Math.min(low, v), Math.max(high, v)];
  }
  const box = (x, y) => ctx.fillRect(px(g.xe[x]), py(g.ye[y + 1]), px(g.xe[x + 1]) - px(g.xe[x]) + 0.5, py(g.ye[y]) - py(g.ye[y + 1]) + 0.5);
  for (let x = 0; x < nx; x++) for (let y = 0; y < ny; y++) {
    const v = value(x, y);
    if (v === null || !isFinite(v)) continue;
    ctx.fillStyle = tint((v - low) / (high - low || 1));
    box(x, y);
  }
  const s = d.states && d.states.groups[$("group").value || 0];
  if ($("states").checked && s) {
    ctx.globalAlpha = 0.45;
    s.bins.forEach((b, i) => {
      ctx.fillStyle = stateColour(s.states[i]).fill;
      box(b % nx, Math.floor(b / nx));
    });
    ctx.globalAlpha = 1;
    ctx.textAlign = "center";
    s.centres.forEach((c) => {
      const colour = stateColour(c.state), label = d.states.labels[c.state], w = 10 + ctx.measureText(label).width;
      ctx.fillStyle = colour.fill;
      ctx.fillRect(px(c.x) - w / 2, py(c.y) - 8, w, 16);
      ctx.fillStyle = colour.text;
      ctx.fillText(label, px(c.x), py(c.y) + 4);
    });
  }
  ctx.strokeStyle = ctx.fillStyle = "#222";
  ctx.strokeRect(left, 8, size, size);
  ctx.textAlign = "center";
  d.ticks.x.forEach((t) => ctx.fillText(t, px(t), size + 24));
  ctx.fillText(d.labels.x, left + size / 2, size + 42);
  ctx.textAlign = "right";
  d.ticks.y.forEach((t) => ctx.fillText(t, left - 6, py(t) + 4));
  pins.forEach((p, i) => {
    const r = byBin.get(p);
    if (!r) return;
    ctx.beginPath();
    ctx.arc(px(r.x), py(r.y), 5, 0, 7);
    ctx.stroke();
    ctx.fillText(i + 1, px(r.x) - 7, py(r.y) - 5);
  });
}

const place = (e) => {
  const r = $("map").getBoundingClientRect();
  return [x0 + ((e.clientX - r.left - left) / size) * (x1 - x0), y1 - ((e.clientY - r.top - 8) / size) * (y1 - y0)];
};
const describe = (r) => d.columns.filter((c) => r[c.key] !== null && r[c.key] !== undefined).map((c) => c.label + ": " + r[c.key]).join("\n");
$("map").onmousemove = (e) => {
  const [x, y] = place(e), i = binOf(x, g.xe), j = binOf(y, g.ye);
  if (i < 0 || j < 0) return;
  const v = value(i, j), r = byBin.get(i + "_" + j);
  $("hover").textContent = d.labels.x + ": " + x.toFixed(2) + "\n" + d.labels.y + ": " + y.toFixed(2) + "\nframes: " + count(i, j) + (v === null ? "" : "\nvalue: " + v.toFixed(4)) + (r ? "\n" + describe(r) : "");
};
$("map").onclick = (e) => {
  const [x, y] = place(e), i = binOf(x, g.xe), j = binOf(y, g.ye);
  if (i < 0 || j < 0) return;
  const r = byBin.get(i + "_" + j) || nearest(records, x, y, x1 - x0, y1 - y0, d.periodic);
  if (r) pin(r.xi + "_" + r.yi);
};

function pin(key) {
  pins = [key, ...pins.filter((p) => p !== key)].slice(0, d.settings.most_pins);
  show(key);
  listPins();
}

async function listPins() {
  const table = $("pins");
  table.replaceChildren();
  if (pins.length) {
    const head = table.insertRow();
    ["", ...d.columns.map((c) => c.label), ""].forEach((t) => (head.appendChild(document.createElement("th")).textContent = t));
  }
  pins.forEach((p, i) => {
    const r = byBin.get(p), row = table.insertRow();
    if (!r) return;
    row.insertCell().textContent = i + 1;
    d.columns.forEach((c) => (row.insertCell().textContent = r[c.key] ?? ""));
    row.onclick = () => show(p);
    const last = row.insertCell(), s = structures.get(p);
    if (s) {
      const a = document.createElement("a");
      a.textContent = "xyz ";
      a.download = p + ".xyz";
      a.href = "data:text/plain," + encodeURIComponent(writeXyz(s));
      last.append(a);
    }
    const off = document.createElement("button");
    off.textContent = "x";
    off.onclick = (e) => {
      e.stopPropagation();
      pins = pins.filter((q) => q !== p);
      listPins();
    };
    last.append(off);
  });
  draw();
  history.replaceState(null, "", pins.length ? "#pins=" + (await pinsToLink(pins)) : "#");
}

function show(key) {
  shown = structures.get(key) || null;
  spin();
}

function spin() {
  mol.clearRect(0, 0, 320, 320);
  if (!shown) return;
  const n = shown.elements.length, [a, b] = turn, p = [], middle = [0, 0, 0];
  for (let i = 0; i < n; i++) for (let k = 0; k < 3; k++) middle[k] += shown.x[3 * i + k] / n;
  let far = 1;
  for (let i = 0; i < n; i++) {
    const [x, y, z] = [0, 1, 2].map((k) => shown.x[3 * i + k] - middle[k]), u = x * Math.cos(a) + z * Math.sin(a), w = z * Math.cos(a) - x * Math.sin(a);
    p.push([u, y * Math.cos(b) - w * Math.sin(b), w * Math.cos(b) + y * Math.sin(b), i]);
    far = Math.max(far, Math.hypot(x, y, z));
  }
  const scale = 140 / far, at = (q) => [160 + q[0] * scale, 160 - q[1] * scale], radius = (i) => d.radii[shown.elements[i]] ?? d.radii[""];
  mol.strokeStyle = "#888";
  for (let i = 0; i < n; i++) for (let j = i + 1; j < n; j++) {
    const far2 = Math.hypot(...[0, 1, 2].map((k) => shown.x[3 * i + k] - shown.x[3 * j + k]));
    if (far2 >= (radius(i) + radius(j)) * d.radii.tolerance) continue;
    mol.beginPath();
    mol.moveTo(...at(p[i]));
    mol.lineTo(...at(p[j]));
    mol.stroke();
  }
  const marked = new Set([...(d.axis_atoms.x || []), ...(d.axis_atoms.y || [])]);
  [...p].sort((u, v) => u[2] - v[2]).forEach((q) => {
    mol.fillStyle = marked.has(q[3]) ? stateColour(0).fill : "#556";
    mol.beginPath();
    mol.arc(...at(q), 4 + 5 * radius(q[3]), 0, 7);
    mol.fill();
    mol.fillStyle = "#fff";
    mol.textAlign = "center";
    mol.fillText(shown.elements[q[3]], at(q)[0], at(q)[1] + 4);
  });
}
$("mol").onmousemove = (e) => {
  if (!e.buttons) return;
  turn = [turn[0] + e.movementX / 80, turn[1] + e.movementY / 80];
  spin();
};

d.units.forEach((u) => $("unit").add(new Option(u.key, u.key)));
$("kelvin").value = d.settings.temperature ?? "";
$("mode").value = d.settings.mode;
(d.states ? d.states.groups : []).forEach((s, i) => $("group").add(new Option(s.name, i)));
$("states").disabled = !d.states;
d.pages.forEach((p) => {
  const a = document.createElement(p.current ? "b" : "a");
  a.textContent = p.title + " ";
  if (!p.current) a.href = p.file;
  $("nav").append(a);
});
["mode", "unit", "kelvin", "states", "group"].forEach((i) => ($(i).onchange = draw));
(async () => {
  draw();
  if (d.frames) records = await decodeColumns(d.frames);
  byBin = new Map(records.map((r) => [r.xi + "_" + r.yi, r]));
  if (d.structures) structures = await decodeStructures(d.structures);
  else structures = new Map(Object.entries(d.xyz || {}).map(([k, t]) => [k, parseXyz(t)]));
  const link = new URLSearchParams(location.hash.slice(1)).get("pins");
  pins = link ? (await pinsFromLink(link)).filter((p) => byBin.has(p)).slice(0, d.settings.most_pins) : [];
  if (pins.length) show(pins[0]);
  listPins();
})();
"""

PAGE = (
    """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>@TITLE@</title><style>
body{font:14px sans-serif;margin:1em;color:#222;background:#fff}
#map{cursor:crosshair}#mol{border:1px solid #ccc;cursor:grab}
#side{display:inline-block;vertical-align:top;margin-left:1em}#hover{white-space:pre-wrap;min-height:12em}
table{border-collapse:collapse;font-size:12px}td,th{border:1px solid #ccc;padding:.1em .4em;text-align:left}tr{cursor:pointer}
</style></head><body><h1>@TITLE@</h1><nav id="nav"></nav>
<p><label>Scale <select id="mode"><option value="log">log10(count + 1)</option><option value="count">count</option><option value="energy">free energy</option></select></label>
<label>Unit <select id="unit"></select></label> <label>T/K <input id="kelvin" size="5"></label> <label><input type="checkbox" id="states"> states</label> <select id="group"></select></p>
<canvas id="map" width="700" height="660"></canvas><div id="side"><canvas id="mol" width="320" height="320"></canvas><div id="hover"></div></div><table id="pins"></table>
<script id="data" type="application/json">@DATA@</script>
<script id="codec">"""
    + CODEC
    + "</script>\n<script>"
    + _VIEW
    + "</script></body></html>\n"
)
