"""The rows that the queries of ``golden`` must give, where they are many: read and found right once, then kept."""

ROWS: dict[str, list[tuple]] = {
    "tree_init": [
        ('module', 'flow.__init__', 0),
        ('module', 'flow.api', 40004),
        ('module', 'flow.hooks', 30001),
        ('module', 'flow.jobs', 40004),
        ('module', 'flow.models', 60100),
        ('module', 'flow.old', 20000),
        ('edges', '', 22),
        ('entry', 'ROUTE /plots: All plots.', 1),
        ('entry', 'GET /plots/<key>: ', 1),
        ('entry', 'ERROR 404: ', 1),
        ('entry', 'Signal: sender=Plot: ', 1),
        ('entry', 'Signal: moved, sender=Bed: ', 1),
        ('entry', 'Signal handler: gone: ', 1),
        ('entry', 'Celery task: refresh: ', 1),
        ('entry', '@register: Waters whatever is dry, every night, and tells what was done in the log.', 1),
    ],
    "tree_summary": [
        ('reason', 'not_in_project', 4),
        ('reason', 'builtin', 2),
        ('reason', 'builtin_method', 1),
        ('reason', 'logging', 1),
        ('caller', 'flow.api.show_plot', 4),
        ('caller', 'flow.jobs.nightly', 4),
        ('caller', 'flow.jobs.walk', 3),
        ('caller', 'flow.jobs.refresh', 2),
        ('caller', 'flow.api.list_plots', 1),
        ('caller', 'flow.api.missing', 1),
        ('caller', 'flow.hooks.saved', 1),
        ('caller', 'flow.hooks.moved', 1),
        ('caller', 'flow.jobs.turn', 1),
        ('caller', 'flow.models.Plot.is_dry', 1),
    ],
    "tree_scan": [
        (1, 'hooks', 3, 'Signal: sender=Plot, Signal: moved, sender=Bed, Signal handler: gone', 'saved', 2),
        (2, 'jobs', 2, 'Celery task: refresh, @register', 'refresh', 5),
        (3, 'list_plots', 1, 'ROUTE /plots', 'list_plots', 2),
        (4, 'show_plot', 1, 'GET /plots/<key>', 'show_plot', 8),
        (5, 'missing', 1, 'ERROR 404', 'missing', 2),
    ],
    "tree_search": [
        ('PLOT', 0, 'flow.api.list_plots', 'garden/flow/api.py', 'function', True),
        ('PLOT', 1, 'flow.api.show_plot', 'garden/flow/api.py', 'function', True),
        ('PLOT', 2, 'flow.models.Plot', 'garden/flow/models.py', 'class', False),
        ('PLOT', 3, 'flow.models.Plot.is_dry', 'garden/flow/models.py', 'method', False),
        ('PLOT', 4, 'flow.models.Plot.wet', 'garden/flow/models.py', 'method', False),
        ('PLOT', 5, 'flow.models.Plot.water', 'garden/flow/models.py', 'method', False),
        ('PLOT', 6, 'flow.models.find_plot', 'garden/flow/models.py', 'function', False),
        ('flow', 0, 'flow.api.list_plots', 'garden/flow/api.py', 'function', True),
        ('flow', 1, 'flow.api.show_plot', 'garden/flow/api.py', 'function', True),
    ],
    "tree_callers": [
        ('flow.api.show_plot', 21, True, 'key'),
        ('flow.jobs.refresh', 9, True, None),
        ('flow.jobs.nightly', 16, True, None),
        ('flow.jobs.nightly', 17, True, None),
        ('flow.jobs.nightly', 18, True, None),
    ],
    "tree_callers_payload": [
        (0, 'flow.jobs.nightly', 'nightly', 14, 'function', False),
        (1, 'flow.jobs.walk', 'walk', 23, 'function', False),
        (2, 'flow.jobs.turn', 'turn', 32, 'function', False),
    ],
    "tree_graph_route": [
        ('flow.jobs.nightly 1', 'trace', 4),
        ('flow.jobs.nightly 5', 'trace', 9),
        ('flow.jobs.walk/callers 5', 'callers', 3),
        ('flow.nothing 5', "Function 'flow.nothing' not found", 0),
        ('flow.jobs.walk 11', 'depth must be 1 to 10', 0),
        ('flow.jobs.walk 0', 'depth must be 1 to 10', 0),
    ],
    "tree_cli_trace": [
        ('node', 'flow.api.show_plot', 'function', '16'),
        ('node', 'flow.jobs.refresh', 'function', '7'),
        ('node', 'flow.models.Plot.is_dry', 'method', '2'),
        ('node', 'flow.models.Plot.water', 'method', '8'),
        ('node', 'flow.models.find_plot', 'function', '12'),
        ('edge', 'flow.api.show_plot', 'flow.models.find_plot', '0 calls'),
        ('edge', 'flow.models.find_plot', 'flow.models.Plot', '1 calls'),
        ('edge', 'flow.api.show_plot', 'flow.models.Plot.is_dry', '2 calls'),
        ('edge', 'flow.models.Plot.is_dry', 'flow.models.Plot.wet', '3 calls'),
        ('edge', 'flow.api.show_plot', 'flow.jobs.refresh', '4 async_dispatch'),
        ('edge', 'flow.jobs.refresh', 'flow.models.find_plot', '5 calls'),
        ('edge', 'flow.jobs.refresh', 'flow.models.Plot.water', '6 calls'),
        ('edge', 'flow.api.show_plot', 'flow.models.Plot.water', '7 calls'),
        ('edge', 'flow.models.Plot.water', 'flow.models.log', '8 calls'),
        ('metadata', '5', '9', '3 1'),
    ],
    "tree_web_trace": [
        ('node', 'flow.api.show_plot', 'True False', '{}'),
        ('node', 'flow.jobs.refresh', 'True False', '{"signal": "post", "signal_emit": true}'),
        ('node', 'flow.models.Plot', 'False False', '{}'),
        ('node', 'flow.models.Plot.is_dry', 'True False', '{"model": "self", "orm_operation": "read"}'),
        ('node', 'flow.models.Plot.wet', 'False False', '{"model": "self", "orm_operation": "read"}'),
        ('node', 'flow.models.Plot.water', 'True False', '{}'),
        ('node', 'flow.models.find_plot', 'True False', '{"model": "Plot", "orm_operation": "read"}'),
        ('node', 'flow.models.log', 'False False', '{}'),
        ('branch', 'flow.api.show_plot', 'plot.is_dry()', 'delay'),
        ('branch', 'flow.api.show_plot', 'key', 'water'),
        ('branch', 'flow.api.show_plot', 'not (key)', 'warning'),
        ('branch', 'flow.api.show_plot', 'not (plot.is_dry())', ''),
        ('edge', 'flow.api.show_plot', 'flow.models.find_plot', None),
        ('edge', 'flow.models.find_plot', 'flow.models.Plot', None),
        ('edge', 'flow.api.show_plot', 'flow.models.Plot.is_dry', None),
        ('edge', 'flow.models.Plot.is_dry', 'flow.models.Plot.wet', None),
        ('edge', 'flow.api.show_plot', 'flow.jobs.refresh', 'plot.is_dry()'),
        ('edge', 'flow.jobs.refresh', 'flow.models.find_plot', None),
        ('edge', 'flow.jobs.refresh', 'flow.models.Plot.water', None),
        ('edge', 'flow.api.show_plot', 'flow.models.Plot.water', 'key'),
        ('edge', 'flow.models.Plot.water', 'flow.models.log', None),
    ],
    "tree_call_tree": [
        (0, 'Found: flow.api.show_plot'),
        (1, 'File: ROOT/flow/api.py:16'),
        (2, 'Decorators: app.get'),
        (3, 'Outgoing calls: 4 (4 cross-file, 1 async)'),
        (4, ''),
        (5, 'show_plot'),
        (6, '  → find_plot [garden/flow/models.py]'),
        (7, '    → Plot'),
        (8, '  → Plot.is_dry [garden/flow/models.py]'),
        (9, '    → Plot.wet'),
        (10, '  ⚡ refresh (celery_delay) [garden/flow/jobs.py]'),
        (11, '    → find_plot [garden/flow/models.py]'),
        (12, '      → Plot'),
        (13, '        ... (max depth)'),
        (14, '    → Plot.water [garden/flow/models.py]'),
        (15, '      → log'),
        (16, '        ... (max depth)'),
        (17, '  → Plot.water [garden/flow/models.py]'),
        (18, '    → log'),
        (19, '  ├─ if plot.is_dry()'),
        (20, '    ⚡ refresh'),
        (21, '      → find_plot [garden/flow/models.py]'),
        (22, '        → Plot'),
        (23, '          ... (max depth)'),
        (24, '      → Plot.water [garden/flow/models.py]'),
        (25, '        → log'),
        (26, '          ... (max depth)'),
        (27, '  ├─ if key'),
        (28, '    → Plot.water'),
        (29, '      → log'),
        (30, '  ├─ else'),
        (31, '    → app.logger.warning() (unresolved)'),
        (32, '  ├─ else'),
        (33, ''),
        (34, 'Reachable: 7 functions across 3 files'),
    ],
    "tree_call_tree_cycle": [
        (0, 'walk'),
        (1, '  → log [garden/flow/models.py]'),
        (2, '  → walk'),
        (3, '    ↻ cycle → walk'),
        (4, '  → turn'),
        (5, '    → walk'),
        (6, '      ↻ cycle → walk'),
        (7, '  ├─ if n > 1'),
        (8, '    → walk'),
        (9, '      ↻ cycle → walk'),
        (10, '  ├─ if n'),
        (11, '  ├─ else'),
        (12, '    → turn'),
        (13, '      → walk'),
        (14, '        ↻ cycle → walk'),
        (15, '--'),
        (16, 'walk'),
        (17, '  → log [garden/flow/models.py]'),
        (18, '  → walk'),
        (19, '    ↻ cycle → walk'),
        (20, '... (more than 4 lines)'),
    ],
    "tree_context": [
        (0, '# garden: codebase analysis'),
        (1, ''),
        (2, 'Modules: 6'),
        (3, 'Functions: 19'),
        (4, 'Entry points: 8'),
        (5, 'Resolved call edges: 22'),
        (6, ''),
        (7, '## Flows'),
        (8, ''),
        (9, '### 1. hooks (3 entry points: 3 signal_handler)'),
        (10, '  Endpoints: Signal: sender=Plot, Signal: moved, sender=Bed, Signal handler: gone'),
        (11, '  Deepest: saved → 2 functions'),
        (12, ''),
        (13, '### 2. jobs (2 entry points: 1 celery_task, 1 discovered)'),
        (14, '  Endpoints: Celery task: refresh, @register'),
        (15, '  Deepest: refresh → 5 functions'),
        (16, ''),
        (17, '### 3. list_plots (1 entry points: 1 api_route)'),
        (18, '  Endpoints: ROUTE /plots'),
        (19, '  Deepest: list_plots → 2 functions'),
        (20, ''),
        (21, '### 4. show_plot (1 entry points: 1 api_route)'),
        (22, '  Endpoints: GET /plots/<key>'),
        (23, '  Deepest: show_plot → 8 functions'),
        (24, ''),
        (25, '### 5. missing (1 entry points: 1 api_route)'),
        (26, '  Endpoints: ERROR 404'),
        (27, '  Deepest: missing → 2 functions'),
        (28, ''),
        (29, '## Entry points by type'),
        (30, ''),
        (31, '**api_route** (3):'),
        (32, '  - ROUTE /plots → list_plots'),
        (33, '  - GET /plots/<key> → show_plot'),
        (34, '  - ERROR 404 → missing'),
        (35, ''),
        (36, '**signal_handler** (3):'),
        (37, '  - Signal: sender=Plot → saved'),
        (38, '  - Signal: moved, sender=Bed → moved'),
        (39, '  - Signal handler: gone → gone'),
        (40, ''),
        (41, '**celery_task** (1):'),
        (42, '  - Celery task: refresh → refresh'),
        (43, ''),
        (44, '**discovered** (1):'),
        (45, '  - @register → nightly'),
        (46, ''),
        (47, '## Top functions by outgoing calls'),
        (48, ''),
        (49, '    4  flow.api.show_plot'),
        (50, '    4  flow.jobs.nightly'),
        (51, '    3  flow.jobs.walk'),
        (52, '    2  flow.jobs.refresh'),
        (53, '    1  flow.api.list_plots'),
        (54, '    1  flow.api.missing'),
        (55, '    1  flow.hooks.saved'),
        (56, '    1  flow.hooks.moved'),
        (57, '    1  flow.jobs.turn'),
        (58, '    1  flow.models.Plot.is_dry'),
        (59, '    1  flow.models.Plot.water'),
        (60, '    1  flow.models.find_plot'),
        (61, '    1  flow.old.a'),
        (62, '    0  flow.api.render'),
        (63, '    0  flow.hooks.gone'),
        (64, ''),
        (65, '## Package structure'),
        (66, ''),
        (67, '    1  flow.__init__'),
        (68, '    1  flow.api'),
        (69, '    1  flow.hooks'),
        (70, '    1  flow.jobs'),
        (71, '    1  flow.models'),
        (72, '    1  flow.old'),
    ],
    "tree_flow_context": [
        (0, '# flow.jobs.refresh: flow analysis'),
        (1, ''),
        (2, 'File: ROOT/flow/jobs.py:7'),
        (3, 'Decorators: shared_task'),
        (4, 'Nodes: 5 | Edges: 4 | Files: 2 | Async boundaries: 0'),
        (5, ''),
        (6, '## Call graph'),
        (7, ''),
        (8, '  refresh → find_plot (cross-file)  # models.py'),
        (9, '  find_plot → Plot  # models.py'),
        (10, '  refresh → water (cross-file)  # models.py'),
        (11, '  water → log  # models.py'),
        (12, ''),
        (13, '## Source code'),
        (14, ''),
        (15, '### refresh (`flow.jobs.refresh`)'),
        (16, '```python'),
        (17, 'def refresh(key):'),
        (18, '    plot = find_plot(key)'),
        (19, '    plot.water()'),
        (20, '    post.send(plot)'),
        (21, '```'),
        (22, ''),
        (23, '### water (`flow.models.Plot.water`)'),
        (24, '```python'),
        (25, '    def water(self):'),
        (26, '        log("water")'),
        (27, '```'),
        (28, ''),
        (29, '### find_plot (`flow.models.find_plot`)'),
        (30, '```python'),
        (31, 'def find_plot(key) -> Plot:'),
        (32, '    return Plot.objects.get(key)'),
        (33, '```'),
        (34, ''),
        (35, '### Plot (`flow.models.Plot`)'),
        (36, '```python'),
        (37, 'class Plot(Model):'),
        (38, '    def is_dry(self):'),
        (39, '        return self.wet().get("x")'),
        (40, ''),
        (41, '    def wet(self):'),
        (42, '        return self.table.rows().first()'),
        (43, ''),
        (44, '    def water(self):'),
        (45, '        log("water")'),
        (46, '```'),
        (47, ''),
        (48, '### log (`flow.models.log`)'),
        (49, '```python'),
        (50, 'def log(text):'),
        (51, '    print(text)'),
        (52, '```'),
    ],
    "tree_skeleton": [
        (0, '## Project skeleton'),
        (1, ''),
        (2, 'Modules: 6'),
        (3, 'Functions: 19'),
        (4, 'Entry points: 8'),
        (5, 'Resolved call edges: 22'),
        (6, ''),
        (7, '### Entry points, by type'),
        (8, ''),
        (9, '**api_route** (3):'),
        (10, '  - ROUTE /plots → list_plots'),
        (11, '  - GET /plots/<key> → show_plot'),
        (12, '  - ERROR 404 → missing'),
        (13, ''),
        (14, '**signal_handler** (3):'),
        (15, '  - Signal: sender=Plot → saved'),
        (16, '  - Signal: moved, sender=Bed → moved'),
        (17, '  - Signal handler: gone → gone'),
        (18, ''),
        (19, '**celery_task** (1):'),
        (20, '  - Celery task: refresh → refresh'),
        (21, ''),
        (22, '**discovered** (1):'),
        (23, '  - @register → nightly'),
        (24, ''),
        (25, '### Functions that call most'),
        (26, ''),
        (27, '    4  flow.api.show_plot'),
        (28, '    4  flow.jobs.nightly'),
        (29, '    3  flow.jobs.walk'),
        (30, '    2  flow.jobs.refresh'),
        (31, '    1  flow.api.list_plots'),
        (32, '    1  flow.api.missing'),
        (33, '    1  flow.hooks.saved'),
        (34, '    1  flow.hooks.moved'),
        (35, '    1  flow.jobs.turn'),
        (36, '    1  flow.models.Plot.is_dry'),
        (37, '    1  flow.models.Plot.water'),
        (38, '    1  flow.models.find_plot'),
        (39, '    1  flow.old.a'),
        (40, '    0  flow.api.render'),
        (41, '    0  flow.hooks.gone'),
        (42, ''),
        (43, '### Largest packages'),
        (44, ''),
        (45, '    1  flow.__init__'),
        (46, '    1  flow.api'),
        (47, '    1  flow.hooks'),
        (48, '    1  flow.jobs'),
        (49, '    1  flow.models'),
        (50, '    1  flow.old'),
    ],
    "tree_overview": [
        ('stat', 'total_modules', '6'),
        ('stat', 'total_functions', '19'),
        ('stat', 'total_edges', '22'),
        ('stat', 'total_unresolved', '8'),
        ('stat', 'total_entry_points', '8'),
        ('entry', 'api_route', 'ROUTE /plots flow.api'),
        ('entry', 'api_route', 'GET /plots/<key> flow.api'),
        ('entry', 'api_route', 'ERROR 404 flow.api'),
        ('entry', 'signal_handler', 'Signal: sender=Plot flow.hooks'),
        ('entry', 'signal_handler', 'Signal: moved, sender=Bed flow.hooks'),
        ('entry', 'signal_handler', 'Signal handler: gone flow.hooks'),
        ('entry', 'celery_task', 'Celery task: refresh flow.jobs'),
        ('entry', 'discovered', '@register flow.jobs'),
        ('name', 'garden', ''),
    ],
    "tree_prompt": [
        (0, '## Flow: `flow.jobs.refresh`'),
        (1, ''),
        (2, 'Nodes: 5 | Edges: 4 | Files: 2 | Async boundaries: 0'),
        (3, ''),
        (4, '## Graph'),
        (5, ''),
        (6, '4 edges'),
        (7, ''),
        (8, '## Source of the key functions'),
        (9, ''),
        (10, '### `flow.jobs.refresh`'),
        (11, '```python'),
        (12, 'def refresh(key):'),
        (13, '    plot = find_plot(key)'),
        (14, '    plot.water()'),
        (15, '    post.send(plot)'),
        (16, '```'),
        (17, ''),
        (18, '### `flow.models.Plot.water`'),
        (19, '```python'),
        (20, '    def water(self):'),
        (21, '        log("water")'),
        (22, '```'),
        (23, ''),
        (24, '### `flow.models.find_plot`'),
        (25, '```python'),
        (26, 'def find_plot(key) -> Plot:'),
        (27, '    return Plot.objects.get(key)'),
        (28, '```'),
        (29, ''),
        (30, '### `flow.models.Plot`'),
        (31, '```python'),
        (32, 'class Plot(Model):'),
        (33, '    def is_dry(self):'),
        (34, '        return self.wet().get("x")'),
        (35, ''),
        (36, '    def wet(self):'),
        (37, '        return self.table.rows().first()'),
        (38, ''),
        (39, '    def water(self):'),
        (40, '        log("water")'),
        (41, '```'),
        (42, ''),
        (43, '### `flow.models.log`'),
        (44, '```python'),
        (45, 'def log(text):'),
        (46, '    print(text)'),
        (47, '```'),
    ],
    "tree_degree": [
        ('turn', 2),
        ('walk', 6),
        ('water', 6),
        ('show_plot', 4),
    ],
}
