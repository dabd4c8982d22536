"""Pure Column expressions (no Python UDFs): everything here compiles into whole-stage codegen."""
