"""Column builders. Nothing here touches Python rows, so every plan stays inside codegen."""
