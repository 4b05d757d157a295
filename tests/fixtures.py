"""Small literal catalogues with known answers."""


def rows(names, *values):
    keys = names.split()
    return [dict(zip(keys, v.split() if isinstance(v, str) else v)) for v in values]


LOOKUPS = {
    "chip_function": rows("function_id label description prospector_band", "cpu CPU x medium", "sound-fm FM x medium", "sound-psg PSG x medium", "custom Custom x hard"),
    "implementation_kind": rows("kind_id label description", "fpga_hdl a b", "software_emulation a b", "original_silicon a b"),
    "fpga_platform": rows("platform_id label", "mister M", "pocket P"),
    "system_kind": rows("kind_id label", "arcade Arcade"),
}


def chips(**functions):
    return [{"chip_id": c.replace("_", "-"), "display_name": c.upper(), "function_id": f} for c, f in functions.items()]


def machine(machine_id, sourcefile, **more):
    return {"machine_id": machine_id, "name": machine_id.title(), "mame_sourcefile": sourcefile, "is_bios": 0, "is_device": 0, "is_mechanical": 0, **more}


def canonical():
    """One family of four chips, one machine, three chip cores and one family core."""
    s = "sega-system16a"
    return {
        **LOOKUPS,
        "chip": chips(m68000="cpu", z80="cpu", ym2151="sound-fm", sega_315_5011="custom"),
        "system": [{"system_id": s, "name": "System 16A", "kind_id": "arcade"}],
        "system_driver": [{"mame_sourcefile": "sega/system16a.cpp", "system_id": s}],
        "system_chip": rows("system_id role_id chip_id quantity", *[(s, r, c, 1) for r, c in (("maincpu", "m68000"), ("audiocpu", "z80"), ("sound", "ym2151"), ("video", "sega-315-5011"))]),
        "machine": [machine("shinobi", "sega/system16a.cpp", mame_year="1987")],
        "machine_chip": [{"machine_id": "shinobi", "mame_tag": t, "chip_id": c, "quantity": 1} for t, c in
                         (("maincpu", "m68000"), ("audiocpu", "z80"), ("ym2151", "ym2151"), ("gfx", "sega-315-5011"))],
        "machine_unmapped_device": [{"machine_id": "shinobi", "mame_device": "sega_315_5195", "quantity": 1}],
        "implementation": rows("implementation_id name kind_id license_id", *[(i, i, "fpga_hdl", lic) for i, lic in
                               (("fx68k", None), ("jt51", "GPL-3.0-only"), ("t80", None), ("core-s16a", None))]),
        "implementation_chip": rows("implementation_id chip_id", "fx68k m68000", "jt51 ym2151", "t80 z80"),
        "implementation_system": rows("implementation_id system_id", f"core-s16a {s}"),
        "implementation_platform": rows("implementation_id platform_id", "core-s16a mister"),
        "implementation_path": rows("implementation_id path is_top", ("fx68k", "fx68k.sv", 1), ("jt51", "hdl/jt51.v", 1), ("jt51", "hdl/jt51_op.v", 0), ("t80", "T80.vhd", 1)),
        "implementation_dependency": rows("consumer_id provider_id", "core-s16a fx68k", "core-s16a jt51", "core-s16a t80"),
    }


SOCKETS = {
    "fx-symmetric": "z80 sn76489 ym2612 sega-315-5011", "fx-68k-hit": "m68010 z80", "fx-68k-miss": "m68030 z80 sn76489", "fx-68k-notrans": "m68000 z80",
    "fx-2a03": "m6502 rp2a03 sn76489", "fx-unmapped-med": "m68020 rp2a03 sn76489 ym3438 z80", "fx-unmapped-low": "m68020 sn76489 ym3438 z80",
    "fx-kind": "z80 ym2151 sega-315-5011", "fx-empty": "",
}


def coverage():
    """Nine families covering every route, unmapped devices and an empty board."""
    hdl = {"fx-2a03-hdl": "rp2a03", "fx-68020-hdl": "m68020", "fx-opn2-hdl": "ym3438", "fx-psg-hdl": "sn76489", "fx-tie-hi-hdl": "fx-tie-hi",
           "fx-tie-lo-hdl": "fx-tie-lo", "fx-z80-hdl": "z80", "fx-z80-hdl-alt": "z80"}
    emu = {"fx-emu-5011": "sega-315-5011", "fx-emu-2151": "ym2151", "fx-emu-z80": "z80"}
    edge = "from_chip_id to_chip_id kind note"
    note = "a note long enough to say where this relation is documented"
    return {
        **LOOKUPS,
        "chip": chips(m6502="cpu", m68000="cpu", m68010="cpu", m68020="cpu", m68030="cpu", rp2a03="cpu", z80="cpu", sn76489="sound-psg", ym2151="sound-fm",
                      ym2612="sound-fm", ym3438="sound-fm", sega_315_5011="custom", fx_tie_hi="custom", fx_tie_lo="custom", fx_tie_socket="custom"),
        "chip_equivalence": rows(edge, ("m68010", "m68000", "provides", note), ("m68020", "m68010", "provides", note), ("m68030", "m68020", "provides", note),
                                 ("ym2612", "ym3438", "equivalent", note), ("fx-tie-hi", "fx-tie-socket", "provides", note), ("fx-tie-lo", "fx-tie-socket", "provides", note)),
        "system": [{"system_id": s, "name": s, "kind_id": "arcade"} for s in SOCKETS],
        "system_driver": rows("mame_sourcefile system_id", "fx/low.cpp fx-unmapped-low", "fx/med.cpp fx-unmapped-med"),
        "system_chip": [{"system_id": s, "role_id": f"r{i}", "chip_id": c, "quantity": 1} for s, cs in SOCKETS.items() for i, c in enumerate(cs.split())],
        "machine": [machine("fxlow1", "fx/low.cpp"), machine("fxmed1", "fx/med.cpp")],
        "machine_unmapped_device": [{"machine_id": m, "mame_device": d, "quantity": 1} for m, d in
                                    (("fxlow1", "fx_gate_array"), ("fxlow1", "fx_pal16r8"), ("fxmed1", "fx_gate_array"))],
        "implementation": [{"implementation_id": i, "name": i, "kind_id": k} for k, group in (("fpga_hdl", [*hdl, "fx-core-symmetric"]), ("software_emulation", emu)) for i in group],
        "implementation_chip": [{"implementation_id": i, "chip_id": c} for i, c in {**hdl, **emu}.items()],
        "implementation_system": rows("implementation_id system_id", "fx-core-symmetric fx-symmetric"),
        "implementation_platform": rows("implementation_id platform_id", "fx-core-symmetric mister"),
    }
