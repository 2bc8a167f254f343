from __future__ import annotations

from .projects import project

TASKS = project({"m": "@shared_task\ndef a(): pass\n@app.task(queue='q')\ndef b(): pass\n@celery_app.task(queue='')\ndef c(): pass\n@task\ndef d(): pass\n"})
CONTROLLERS = project({"m": "@route.get('/first')\ndef z(): pass\n@api_controller('/a')\nclass A:\n    @route.get('')\n    def one(self): pass\n    @route.post('/x')\n    def two(self): pass\n@api_controller\nclass B:\n    @route.delete('/y')\n    def three(self): pass\n"})
SIGNALS = project({"m": "@receiver(post_save, sender='A')\ndef a(): pass\n@receiver('s', sender='B')\ndef b(): pass\n@receiver(x)\ndef c(): pass\n"})
_ROUTES = "@app.get('/a')\ndef a(): pass\n@app.websocket('/w')\ndef w(): pass\n@router.put()\ndef b(): pass\n@app.route('/r', methods=['POST'])\ndef r(): pass\n@app.errorhandler(404)\ndef e(): pass\n"
PLAIN, FASTAPI, FLASK, BOTH = (project({"m": head + _ROUTES}) for head in ("", "from fastapi import FastAPI\n", "import flask\n", "import flask\nfrom fastapi import APIRouter\n"))
TOPOLOGY = project({"m": "def g(): pass\n@property\n@reg.it('x')\ndef a():\n    '''Why.'''\n    g()\n@staticmethod\ndef noise():\n    g()\n@reg\ndef called():\n    g()\n@reg\ndef calls_none(): pass\n@reg\ndef itself():\n    itself(); g()\n@reg\nclass K:\n    pass\ndef h():\n    called()\n"})
NOTES = project({"m": "def f():\n    A.objects.filter(1).first()\n    B.objects.create()\n    if x:\n        C.objects.delete()\n    s.sig.send(1)\n    t.connect(f)\ndef g():\n    filter(1)\n"})


def triggers(found, name):
    return [t for _, _, t in found.entries(name)]


def test_tasks(found):
    assert found.entries(TASKS) == [("a", "celery_task", "Celery task: a"), ("b", "celery_task", "Celery task: b (queue=q)"), ("c", "celery_task", "Celery task: c")]


def test_controllers_carry_their_prefix_forward(found):
    assert triggers(found, CONTROLLERS) == ["GET /first", "Controller: /a", "GET /a", "POST /a/x", "Controller: /", "DELETE /y"]


def test_signal_handlers(found):
    assert triggers(found, SIGNALS) == ["Signal: sender=A", "Signal: s, sender=B", "Signal handler: c"]


def test_routes_need_their_framework(found):
    assert triggers(found, PLAIN) == []
    assert triggers(found, FASTAPI) == ["GET /a", "WS /w", "PUT /"]
    assert triggers(found, FLASK) == ["GET /a", "PUT /", "ROUTE /r", "ERROR 404"]
    assert len(triggers(found, BOTH)) == 7


def test_what_only_decorators_register(found):
    assert found.entries(TOPOLOGY) == [("a", "discovered", "@reg.it")]


def test_annotations(found):
    assert found.annotations(NOTES) == [{"qualified_name": "m.f", "orm_operation": "write", "model": "B", "signal": "t", "signal_connection": True, "signal_emit": True}]
